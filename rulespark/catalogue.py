"""Registry of the engine's own queries and their SQL."""

from rulespark import catalogue_corpus, catalogue_events, catalogue_more, catalogue_scans

QUERIES: dict = catalogue_events.QUERIES | catalogue_scans.QUERIES | catalogue_corpus.QUERIES | catalogue_more.QUERIES
ORACLES: dict = catalogue_events.ORACLES | catalogue_scans.ORACLES | catalogue_corpus.ORACLES | catalogue_more.ORACLES
