"""larkspur: evidence audit, retrieval and corpus preparation as PySpark DataFrame plans."""
