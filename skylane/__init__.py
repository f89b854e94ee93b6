"""Star-map ingest, routing, scouting and monitoring as Spark DataFrame jobs."""
