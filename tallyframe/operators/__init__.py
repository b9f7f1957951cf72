"""Dataset transforms, statistics, tables and validation."""
