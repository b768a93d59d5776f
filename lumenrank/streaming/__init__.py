"""Streams. An extension: sessions and leaders as shots come in."""
