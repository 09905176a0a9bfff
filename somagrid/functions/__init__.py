"""Functions of the package."""
