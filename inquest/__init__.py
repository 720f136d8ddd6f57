"""Questions to a model as ordinary Spark columns."""
