"""An HTML report from aggregated tables. Every table is a query over aggregated rows."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame


def section(title: str, df: DataFrame, rows: int | None = None) -> str:
    """A table of all rows in their order, which come one partition at a time; or of the first ``rows``, saying how many more there are."""
    shown = list((df if rows is None else df.limit(rows)).toLocalIterator())
    more = 0 if rows is None or len(shown) < rows else df.count() - len(shown)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('—' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in shown)
    note = f"<p>{more} more rows</p>" if more else ""
    return f"<section><h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>{note}</section>"


def sparkline(points: list[float], width: int = 160, height: int = 36) -> str:
    """A line of points between 0 and 1; none for fewer than two."""
    if len(points) < 2:
        return ""
    step = width / (len(points) - 1)
    path = " ".join(f"{i * step:.1f},{height - p * height:.1f}" for i, p in enumerate(points))
    return f"<svg viewBox='0 0 {width} {height}'><polyline fill='none' stroke='currentColor' points='{path}'/></svg>"


def held_out_banner(commits: int, runs: int, times: int) -> str:
    again = f" This commit has scored it {times} times." if times > 1 else ""
    return f"<p class='held'>Held out: scored at {commits} commits, {runs} runs in all.{again} No choice may be made from it.</p>"


def render(title: str, sections: dict[str, DataFrame], extra: str = "") -> str:
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{extra}" + "".join(section(t, d) for t, d in sections.items())
