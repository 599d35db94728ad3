"""Sources: scans from a position, change logs and their decoders."""
