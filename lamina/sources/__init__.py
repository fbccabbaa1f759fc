"""Base tables, delimited text, Arrow IPC stripes."""
