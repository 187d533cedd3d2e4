"""Routing, catalog and the persistent store."""
