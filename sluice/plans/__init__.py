"""Specs, state, schema evolution, bounded runs and the SQL subset."""
