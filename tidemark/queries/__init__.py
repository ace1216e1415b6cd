"""Registered queries of the engine's own operators, each with DuckDB SQL for the same rows."""

from . import front, metrics, relational, scalars, storage

QUERIES = {**metrics.QUERIES, **relational.QUERIES, **scalars.QUERIES, **storage.QUERIES, **front.QUERIES}
ORACLE_SQL = {**metrics.ORACLE_SQL, **relational.ORACLE_SQL, **scalars.ORACLE_SQL, **storage.ORACLE_SQL, **front.ORACLE_SQL}
