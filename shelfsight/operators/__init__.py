"""The analyses: each takes the tables and its parameters and returns a DataFrame."""
