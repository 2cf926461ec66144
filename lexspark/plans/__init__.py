"""Pipeline descriptions and the engine."""
