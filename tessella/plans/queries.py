"""All queries of the core library, by name; `SQL` has the same for an independent engine."""

from __future__ import annotations

from . import analytics, documents, dml, entities, flows, joins, metrics, ranking, scalars, selections, streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
