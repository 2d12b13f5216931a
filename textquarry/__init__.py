"""textquarry: text search, context windows and corpus preparation on Spark."""
