"""File inventories, document images and their logs as Spark tables."""
