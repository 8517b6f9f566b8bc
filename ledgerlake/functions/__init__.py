"""Column expressions: partition transforms, clustering keys, masks."""
