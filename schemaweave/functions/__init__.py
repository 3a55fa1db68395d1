"""Column factories and Arrow functions."""
