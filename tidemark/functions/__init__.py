"""Column functions: text, time, geometry, JSON, fuzzy scores."""
