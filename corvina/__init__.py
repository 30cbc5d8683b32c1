"""Full-text analytics and retrieval on Spark: parse, analyse, index, search, evaluate."""

__version__ = "0.1.0"
