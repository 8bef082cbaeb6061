"""Reports from the small results: one self-contained HTML page, JSON, or PDF where a renderer is installed."""

from __future__ import annotations

import json
import math
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame

from ..errors import DependencyError, EDAError, ReportGenerationError
from ..functions.columns import categorical_columns, numeric_columns
from ..operators import charts
from .formatters import html_table

STYLE = "body{font-family:sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}h2{border-bottom:1px solid #ccc}"


def serializable(v):
    """NaN and infinities as null, dates as text, keys as strings."""
    if isinstance(v, dict):
        return {str(k): serializable(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [serializable(x) for x in v]
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    return serializable(v.item()) if hasattr(v, "item") else str(v)


def figures(df: DataFrame, most: int = 6) -> dict[str, str]:
    """SVG charts of the first columns; one that fails leaves the others."""
    out: dict[str, str] = {}
    for c in numeric_columns(df)[:most]:
        try:
            rows = charts.histogram(df, c, 20).orderBy("bin").collect()
            out[c] = charts.svg_bars([(f"{r.low:.4g}", float(r.n)) for r in rows], f"Histogram of {c}")
        except (EDAError, ValueError, ArithmeticError) as error:
            out[c] = f"<p>{escape(c)}: {escape(str(error))}</p>"
    for c in categorical_columns(df)[:most]:
        out[c] = charts.svg_bars([(str(r.label), float(r.value)) for r in charts.bars(df, c, top=10).collect()], f"Most frequent values of {c}")
    return out


def _rows(columns: dict[str, dict], limit: int | None = None) -> list[dict]:
    return [{"column": c, **r} for c, r in list(columns.items())[:limit]]


def build_html(results: dict, df: DataFrame | None, title: str, include_visualizations: bool = True, include_data_preview: bool = True, max_preview_rows: int = 10) -> str:
    over, stats, quality = results.get("overview", {}), results.get("statistics", {}), results.get("quality", {})
    parts: list[tuple[str, str]] = [("Overview", html_table([{k: v for k, v in over.items() if not isinstance(v, dict)}]))]
    parts.append(("Insights", "".join(f"<h3>{escape(k)}</h3><ul>" + "".join(f"<li>{escape(t)}</li>" for t in v) + "</ul>" for k, v in results.get("insights", {}).items())))
    if "quality_score" in quality:
        parts.append(("Quality", html_table([quality["quality_score"]]) + html_table(_rows(quality["missing_values"]["columns"]), "Missing values") + html_table(quality["consistency"], "Consistency")))
    parts.append(("Statistics", html_table(_rows(stats.get("descriptive", {}))) + html_table(_rows(stats.get("categorical", {})))))
    for method, rows in results.get("outliers", {}).get("outliers", {}).items():
        parts.append((f"Outliers ({method})", html_table(_rows(rows))))
    strong = results.get("correlations", {}).get("strong_correlations", {})
    parts.append(("Correlations", html_table(strong.get("pairs", [])) + html_table(results.get("correlations", {}).get("multicollinearity", []), "Variance inflation")))
    if df is not None and include_visualizations:
        parts.append(("Charts", "".join(f"<figure>{s}</figure>" for s in figures(df).values())))
    if df is not None and include_data_preview:
        parts.append(("Preview", html_table([r.asDict() for r in df.limit(max_preview_rows).collect()])))
    contents = "".join(f'<li><a href="#s{i}">{escape(n)}</a></li>' for i, (n, _) in enumerate(parts))
    body = "".join(f'<h2 id="s{i}">{escape(n)}</h2>{b or "<p>nothing to show</p>"}' for i, (n, b) in enumerate(parts))
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1><ul>{contents}</ul>{body}</body></html>'


def write_report(results: dict, df: DataFrame | None, path: str | Path, format: str = "html", title: str = "Data report", **options) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    if format == "json":
        path.write_text(json.dumps({"metadata": serializable(results.get("metadata", {})), "results": serializable(results)}, indent=2), encoding="utf-8")
    elif format == "html":
        path.write_text(build_html(results, df, title, **options), encoding="utf-8")
    elif format == "pdf":
        try:
            import weasyprint
        except ImportError as error:
            raise DependencyError("PDF reports need weasyprint", suggestions=["write HTML"], original=error) from error
        weasyprint.HTML(string=build_html(results, df, title, **options)).write_pdf(str(path))
    else:
        raise ReportGenerationError("unknown format", {"format": format}, ["html, json or pdf"])
    return path
