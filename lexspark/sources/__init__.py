"""Pipeline descriptions and texts from files."""
