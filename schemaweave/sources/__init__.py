"""Readers that turn files and DataFrames into rows of text cells."""
