"""Operators on versioned tables: row deletes, changes, compaction, partitions, maintenance, security."""
