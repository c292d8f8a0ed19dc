"""Column functions with the byte semantics of fixed-width fields."""
