"""A PySpark engine for ordered, hierarchical and semi-structured data."""
