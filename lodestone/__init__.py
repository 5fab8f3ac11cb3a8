"""lodestone: retrieval, catalog and log analytics as Spark DataFrame plans."""
