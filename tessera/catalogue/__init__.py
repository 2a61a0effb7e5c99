"""Every registered query of the library with its oracle SQL."""

from __future__ import annotations

from tessera.catalogue import graphs, ingestion, quality, relational, retrieval, similarity, stored, telemetry, texts
from tessera.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graphs", "ingestion", "quality", "relational", "retrieval", "similarity", "stored", "telemetry", "texts"]
