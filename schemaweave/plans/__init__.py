"""Mapping plans and their compilation to Catalyst expressions."""
