"""Planning, reporting and the end-to-end pipeline."""
