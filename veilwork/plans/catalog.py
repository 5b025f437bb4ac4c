"""All registered queries by name, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from veilwork.plans import batch_queries, document_queries, redaction_queries

CATALOG = {**redaction_queries.QUERIES, **document_queries.QUERIES, **batch_queries.QUERIES}
