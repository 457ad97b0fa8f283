"""Files to extracted text, and tables and files out again."""
