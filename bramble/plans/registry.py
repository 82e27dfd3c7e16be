"""All registered queries of the engine, with their SQL."""

from bramble.plans import catalogue, extras

QUERIES = catalogue.QUERIES | extras.QUERIES
ORACLES = catalogue.ORACLES | extras.ORACLES
