"""Column functions: no data moves here."""
