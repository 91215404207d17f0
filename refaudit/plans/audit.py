"""Orphan audit of manuscripts: paragraphs in, citations and findings out."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from refaudit.operators import citations as C
from refaudit.operators import edits as E
from refaudit.session import stage_table


@dataclass
class Audit:
    references: DataFrame
    limits: DataFrame
    citations: DataFrame
    findings: DataFrame


def analyze(paragraphs: DataFrame, refs: DataFrame | None = None, ranges: DataFrame | None = None, context: bool = True) -> Audit:
    """Extract, put in context, resolve and report. ``refs`` defaults to the bibliography found in the text.

    Without ``context`` the same citations come without their ``sentence`` and ``context`` columns.
    """
    limits = stage_table(C.bibliography_range(paragraphs, ranges), "limits")
    refs = stage_table(C.extract_references(paragraphs, limits=limits) if refs is None else refs, "refs")
    cites = C.citations_in_context(C.paragraph_history(paragraphs, limits), refs) if context else C.citations_in_place(paragraphs, refs, limits)
    audited = stage_table(C.audit_citations(stage_table(cites, "citations"), refs), "audited")
    return Audit(refs, limits, audited, C.findings(audited, refs))


def reanalyze(paragraphs: DataFrame, refs: DataFrame, patches: DataFrame, matches: DataFrame, ranges: DataFrame | None = None) -> Audit:
    """Audit of the edited text on the original anchors, with the user's matches on top.

    Accepted entry texts enter through ``refs.raw``; orphans are recomputed at the end.
    """
    base = analyze(paragraphs, refs, ranges)
    edited = E.apply_patches(paragraphs, patches)
    effective = analyze(edited, C.with_identity(refs), ranges)
    linked = E.refresh_result_links(base.citations, effective.citations, patches)
    final = stage_table(E.apply_manual_matches(linked, matches, refs, paragraphs), "reanalyzed")
    return Audit(refs, base.limits, final, C.findings(final, refs))
