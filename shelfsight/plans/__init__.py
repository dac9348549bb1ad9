"""Logical plans several operators share."""
