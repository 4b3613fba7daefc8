"""Column functions: names, dates, templates, geometry, hashes."""
