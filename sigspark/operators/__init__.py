"""Relational and model operators on event and site tables."""
