"""A PySpark engine for document-evidence tables and training-data corpora."""
