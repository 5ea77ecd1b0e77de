"""tierspark: move event data between stores and read it back through tiered views, on Spark."""
