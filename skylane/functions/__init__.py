"""Column expressions: geometry, temperature, fuel, heat and text."""
