"""Queries over the tables, each with its SQL where SQL can express it."""
