"""Content and change analytics on Spark."""
