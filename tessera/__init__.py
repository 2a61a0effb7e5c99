"""A PySpark-native engine for document corpora: ingestion, cleaning, enrichment, a knowledge
graph, retrieval, data quality and telemetry, all as DataFrame and Column expressions."""
