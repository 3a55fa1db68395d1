"""Checks of arriving files in micro-batches."""
