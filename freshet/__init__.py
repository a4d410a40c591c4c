"""Fresh-listings analytics on Spark: ingest, snapshot CDC, facets, ranked search and feed health."""
