"""SQL-text analytics and text-corpus preparation on Spark."""
