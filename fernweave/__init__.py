"""fernweave: hybrid text-retrieval analytics expressed as PySpark plans."""
