"""Column functions: calendar, physics, text and array expressions."""
