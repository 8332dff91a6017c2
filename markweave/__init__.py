"""markweave: rating analytics and experiment pipelines as plain Spark DataFrame queries."""

__version__ = "0.1.0"
