"""Scalar functions that Spark lacks or defines otherwise."""
