"""A small typed plan language over facts, as DataFrame expressions."""
