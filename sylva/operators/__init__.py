"""Operators over forests: tree primitives, schema inference, quality, clustering and rewriting."""
