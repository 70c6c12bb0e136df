"""Imports every module that registers queries."""

from quarrystat.operators import bound, buckets, corrected, edges, findings, graph, ingest, learning, models, moments, primitives, process, queueing, recursions, relational, sequences, statistics, tested  # noqa: F401
