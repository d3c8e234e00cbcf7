"""Operators on the operational tables: timestamps, hierarchies, drifting schemas, nested records, recall, lifecycle."""
