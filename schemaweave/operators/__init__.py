"""Operators over DataFrames: profiling, scoring, dry runs, layouts, feedback and evaluation."""
