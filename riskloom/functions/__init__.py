"""Column builders: scalar cleaning, times, arrays and aggregates."""
