"""Operators that Spark has no single call for, built from those that it has."""
