"""PySpark operators for curating corpora of figures found in parsed documents."""
