"""Registered queries: a Spark plan and, where SQL can say it, the same in DuckDB SQL."""

from tidemark.plans import bars, evaluation, features, ingest, labelling, learned, profiles, relational, round_trips, streams  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
