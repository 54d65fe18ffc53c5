"""Log files and cluster metric snapshots as Spark tables."""
