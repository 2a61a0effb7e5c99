"""Column functions: text, validation, enrichment, similarity and vectors."""
