"""Column functions and scalar distribution functions."""
