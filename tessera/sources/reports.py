"""Markdown reports from small aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table for people has at most so many rows; a larger one belongs in a file.
MOST_ROWS = 1000


def shown(value: object) -> str:
    if value is None:
        return ""
    return f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else f"{value:.4g}" if isinstance(value, float) else str(value).replace("|", "\\|")


def markdown_table(df: DataFrame, title: str = "", order: list[str] | None = None) -> str:
    """A table of results; more than ``MOST_ROWS`` rows are an error, as none is left out."""
    rows = (df.orderBy(*order) if order else df).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows; write the table to a file instead")
    head = [f"### {title}", ""] if title else []
    return "\n".join([*head, "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(shown, r)) + " |" for r in rows)]) + "\n"
