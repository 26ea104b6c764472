"""Reading and writing catalogue data."""
