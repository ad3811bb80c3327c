"""Relational operators on order lines and demand series."""
