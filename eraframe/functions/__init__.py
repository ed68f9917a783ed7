"""Part of eraframe; see the package docstring."""
