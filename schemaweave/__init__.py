"""schemaweave: understand and safely prepare tabular data with Spark DataFrames."""

__version__ = "0.1.0"
