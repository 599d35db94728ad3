"""Transforms: predicates, operators and chains of them."""
