"""The package's operators."""
