"""Statements other than queries: schema changes and reports."""
