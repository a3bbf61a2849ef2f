"""Document analytics on Spark: relational operators over parsed documents."""

__version__ = "0.1.0"
