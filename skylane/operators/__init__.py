"""DataFrame operators: edges, search, enrichment, scouting, corpus and quality."""
