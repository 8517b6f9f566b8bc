"""Planning before the scan: predicates, statistics, which files to read."""
