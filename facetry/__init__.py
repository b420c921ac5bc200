"""facetry: full-text search, facets and key joins between datasets, as Spark DataFrame plans."""

__version__ = "0.1.0"
