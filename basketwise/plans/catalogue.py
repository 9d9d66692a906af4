"""Every registered query, in the order of the operator inventory."""

from __future__ import annotations

from basketwise.plans import (
    q_curate, q_eval, q_features, q_ingest, q_models, q_prep, q_profile, q_sources, q_stream,
)

_PARTS = (q_curate, q_ingest, q_features, q_profile, q_prep, q_eval, q_models, q_stream, q_sources)

QUERIES = {name: fn for part in _PARTS for name, fn in part.R.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.R.oracles.items()}
