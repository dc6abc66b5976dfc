"""Running counters over arriving data."""
