"""Readers: CSV import, templates, XSD schemas, HTML listings, quotes and ticks."""
