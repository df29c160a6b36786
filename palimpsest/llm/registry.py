"""Queries of this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_cooccur", "q_softlink", "q_spans", "q_scans", "q_leaks", "q_packing", "q_names", "q_residue", "q_subjects"]


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"palimpsest.llm.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
