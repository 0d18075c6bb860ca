"""softlab.streaming."""
