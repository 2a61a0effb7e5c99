"""End-to-end plans: ingestion to entity tables, the graph, retrieval, and the document API."""
