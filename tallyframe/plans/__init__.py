"""Queries registered for the driver, with their SQL."""
