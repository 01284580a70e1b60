"""Reading and writing session documents and tables."""
