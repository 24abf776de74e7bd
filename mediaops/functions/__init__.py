"""Column functions: parsing, formats, geometry, keys."""
