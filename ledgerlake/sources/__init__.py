"""File formats: reading, writing, options."""
