"""Composite object builders and the registered queries on the driver tables."""
