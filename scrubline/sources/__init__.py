"""Reading tables and seed data."""
