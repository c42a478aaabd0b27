"""vellum: corpus preparation and hybrid retrieval as PySpark DataFrame plans."""
