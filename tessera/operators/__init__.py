"""DataFrame operators: relational shapes, deduplication, graph, search, quality, telemetry, traces."""
