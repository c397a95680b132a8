"""The package's sources."""
