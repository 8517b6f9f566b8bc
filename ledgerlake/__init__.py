"""Versioned tables on Spark: snapshots, changes, pruning, deletes, compaction and streams over immutable files."""
