"""The package's streaming."""
