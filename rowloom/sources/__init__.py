"""Reading tables and documents, and writing results."""
