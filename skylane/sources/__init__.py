"""Readers and writers for map tables, ship catalogues, route corpora and results."""
