"""Queries over the star tables, each with its SQL."""
