"""Column helpers and parameter checks."""
