"""DuckDB SQL equivalents of the queries, written independently of the operators.

Successors are found by as-of joins, cumulative flags by range self joins and
scenarios by unions, where the operators use windows and single scans.
"""

from __future__ import annotations

from oracle import extracts, model, reports


def build() -> dict[str, str]:
    parts = (
        reports.load,
        reports.quality,
        reports.views,
        reports.kpis,
        reports.delinquency,
        reports.book,
        reports.default_probability,
        reports.loss_given_default,
        reports.exposure,
        reports.expected_loss,
        reports.migration,
        reports.vintage,
        extracts.frames,
        extracts.charts,
        extracts.exports,
        extracts.dashboards,
        extracts.default_model,
        model.default_model,
    )
    out: dict[str, str] = {}
    for part in parts:
        out.update(part())
    return out
