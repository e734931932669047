"""taxalake: biodiversity data ingest and taxon-graph analysis as Spark DataFrame jobs."""
