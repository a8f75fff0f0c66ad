"""Column functions: placement, canonical keys, SQL text, PostgreSQL-style aggregates."""
