"""incipit: technical documents as Spark relations - layout, structure, search, evidence and corpus preparation."""
