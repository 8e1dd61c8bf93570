"""Registered queries: operators bound to tables, each beside its SQL."""

from scholargraph.plans import (  # noqa: F401
    audit_queries,
    citation_queries,
    corpus_queries,
    decision_queries,
    evidence_queries,
    layout_queries,
    library_queries,
    link_queries,
    provenance_queries,
    resolve_queries,
    state_queries,
    stream_queries,
    text_queries,
)
