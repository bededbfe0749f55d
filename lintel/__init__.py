"""lintel: schema and SQL-migration analysis expressed as Spark plans."""
