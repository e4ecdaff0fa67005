"""Named query plans (the registry the driver runs) and their DuckDB oracle SQL."""
