"""softlab.operators."""
