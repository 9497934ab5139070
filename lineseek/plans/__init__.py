"""Plan-level helpers (sizing, scratch tables) and the query catalogue."""
