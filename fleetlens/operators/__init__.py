"""The reports, by subject. Each takes a Catalog and returns a DataFrame."""
