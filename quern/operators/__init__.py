"""Operators that Spark has no name for, composed of those that it has."""
