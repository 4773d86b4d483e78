"""Operators on tables of pages and leads."""
