"""lamina: stripe tables and relational queries on Spark."""

__version__ = "0.1.0"
