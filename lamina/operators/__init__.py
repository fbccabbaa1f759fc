"""Operators over stripe tables: scans, changes, maintenance, introspection."""
