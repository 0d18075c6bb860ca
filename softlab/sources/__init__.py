"""softlab.sources."""
