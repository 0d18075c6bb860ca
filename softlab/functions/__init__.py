"""softlab.functions."""
