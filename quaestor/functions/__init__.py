"""The package's functions."""
