"""All registered queries of the core and their SQL twins."""

from dialogprep.plans import model_queries, oracles, queries, source_queries

QUERIES = {**queries.QUERIES, **source_queries.QUERIES, **model_queries.QUERIES}
ORACLES = {**oracles.ORACLES, **source_queries.ORACLES, **model_queries.ORACLES}
