"""Versioned key-value analytics on Spark: an append-only change log and every read and maintenance job over it."""
