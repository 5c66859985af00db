"""Logical plans, written once as SQL, and the catalogue of named queries."""
