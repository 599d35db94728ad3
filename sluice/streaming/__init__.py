"""Event time, change streams, and progress."""
