"""Readers that turn relational tables, documents, property graphs and annotated text into a forest."""
