"""Versioned key-value analytics on Spark: change logs, sorted runs, levels and snapshots as DataFrame plans."""
