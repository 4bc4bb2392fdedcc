"""shelfwise: catalogue analytics on Spark, written with DataFrame operations."""
