"""The index: its tables, and how they are built, written, opened and deleted."""
