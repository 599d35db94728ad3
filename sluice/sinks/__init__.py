"""Sinks: batch folders, event logs, keyed tables and dead letters. Loading a batch twice is loading it once."""
