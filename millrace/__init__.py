"""millrace: usage, content and training-data analytics written directly on PySpark."""
