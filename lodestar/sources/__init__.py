"""Table registration, readers and writers."""
