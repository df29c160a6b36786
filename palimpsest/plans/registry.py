"""All queries of the core, by name, each as a callable of (session, folder)."""

from __future__ import annotations

from importlib import import_module

MODULES = [f"palimpsest.operators.{m}_queries" for m in ("skew", "text", "overlap", "matches", "graph", "features", "retrieval", "study", "citations", "release")]
FLAGSHIP = "agg_pair_summary"


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(m), what)
        if twice := out.keys() & part.keys():
            raise ValueError(f"query named twice: {sorted(twice)}")
        out |= part
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
