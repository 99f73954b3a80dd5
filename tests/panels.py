"""Hand-written statement rows, and results as plain rows."""

from datetime import date


def bucket(dpd):
    return "0" if dpd == 0 else "1-29" if dpd < 30 else "30-59" if dpd < 60 else "60-89" if dpd < 90 else "90+"


def statement(card, month, balance=1000, min_due=30, paid=100, dpd=0, label=None, limit=2000, spent=50):
    """One statement row; ``month`` counts from January 2022."""
    return (
        card,
        date(2022 + month // 12, month % 12 + 1, 1),
        balance,
        min_due,
        paid,
        dpd,
        label if label is not None else bucket(dpd) if dpd is not None else None,
        limit,
        spent,
    )


def rows(df, *columns):
    """Rows as tuples of the chosen columns, in the frame's order."""
    return [tuple(r[c] for c in (columns or df.columns)) for r in df.collect()]
