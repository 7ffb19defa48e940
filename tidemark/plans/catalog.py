"""Every registered query of the engine with its SQL."""

from __future__ import annotations

from tidemark.plans import analytics, features, filing_rows, labels, landed_rows, legacy_labels, models, news, page_rows, policies, rank_policies, timing

QUERIES = features.QUERIES | filing_rows.QUERIES | models.QUERIES | page_rows.QUERIES | timing.QUERIES | analytics.QUERIES | labels.QUERIES | legacy_labels.QUERIES | landed_rows.QUERIES | news.QUERIES | policies.QUERIES | rank_policies.QUERIES
ORACLES = features.ORACLES | filing_rows.ORACLES | models.ORACLES | page_rows.ORACLES | timing.ORACLES | analytics.ORACLES | labels.ORACLES | legacy_labels.ORACLES | landed_rows.ORACLES | news.ORACLES | policies.ORACLES | rank_policies.ORACLES
