"""Numbers, durations and small tables as text."""

from __future__ import annotations

import json
from datetime import datetime
from html import escape


def percentage(value: float, decimals: int = 2, sign: bool = True) -> str:
    """Values up to 1 are shares, larger ones per cents already."""
    return f"{value * 100 if value <= 1 else value:.{decimals}f}" + ("%" if sign else "")


def number(value: float, decimals: int = 2, thousands: bool = True) -> str:
    return f"{value:{',' if thousands else ''}.{decimals}f}"


def large_number(value: float, decimals: int = 1) -> str:
    for size, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(value) >= size:
            return f"{value / size:.{decimals}f}{unit}"
    return f"{value:.{decimals}f}"


def currency(value: float, symbol: str = "$", decimals: int = 2) -> str:
    return f"{'-' if value < 0 else ''}{symbol}{abs(value):,.{decimals}f}"


def file_size(size: float, decimals: int = 2) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB", "PB"):
        if abs(size) < 1024:
            return f"{size:.{decimals}f} {unit}"
        size /= 1024
    return f"{size:.{decimals}f} EB"


def duration(seconds: float, verbose: bool = False, max_units: int = 2) -> str:
    parts, rest = [], seconds
    for size, short, name in ((86400, "d", "day"), (3600, "h", "hour"), (60, "m", "minute")):
        n, rest = divmod(rest, size)
        if n:
            parts.append(f"{int(n)} {name}{'s' * (n != 1)}" if verbose else f"{int(n)}{short}")
    if rest or not parts:
        parts.append(f"{rest:g} second{'s' * (rest != 1)}" if verbose else f"{rest:g}s")
    return (", " if verbose else " ").join(parts[:max_units])


def timestamp(value: datetime, pattern: str = "%Y-%m-%d %H:%M:%S") -> str:
    return value.strftime(pattern)


def value(v, decimals: int = 2) -> str:
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return percentage(v, decimals) if 0 <= v <= 1 and not v.is_integer() else number(v, decimals)
    if isinstance(v, int):
        return large_number(v) if abs(v) > 1_000_000 else f"{v:,}"
    return str(v)


def to_json(data: dict, pretty: bool = True, sort_keys: bool = False) -> str:
    return json.dumps(data, indent=2 if pretty else None, sort_keys=sort_keys, default=str)


def to_markdown(data: dict, title: str | None = None, level: int = 1) -> str:
    lines = [f"# {title}", ""] if title else []
    for k, v in data.items():
        if isinstance(v, dict):
            lines += [f"{'#' * min(6, level + 1)} {k}", "", to_markdown(v, level=level + 1)]
        else:
            lines.append(f"- **{k}**: {v}")
    return "\n".join(lines) + "\n"


def markdown_table(headers: list[str], rows: list[list], align: list[str] | None = None) -> str:
    marks = {"left": ":---", "right": "---:", "center": ":---:"}
    lines = ["| " + " | ".join(headers) + " |", "| " + " | ".join(marks[a] for a in align or ["left"] * len(headers)) + " |"]
    return "\n".join(lines + ["| " + " | ".join(str(c) for c in r) + " |" for r in rows])


def html_table(records: list[dict], title: str | None = None, classes: str = "table") -> str:
    if not records:
        return ""
    head = "".join(f"<th>{escape(str(k))}</th>" for k in records[0])
    body = "".join("<tr>" + "".join(f"<td>{escape(value(v) if isinstance(v, (int, float)) else str(v))}</td>" for v in r.values()) + "</tr>" for r in records)
    return (f"<h3>{escape(title)}</h3>" if title else "") + f'<table class="{escape(classes)}"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>'


def csv_text(records: list[dict]) -> str:
    import csv
    import io

    out = io.StringIO()
    if records:
        writer = csv.DictWriter(out, list(records[0]), lineterminator="\n")
        writer.writeheader()
        writer.writerows(records)
    return out.getvalue()


def statistical_summary(data: dict, decimals: int = 2) -> str:
    return "\n".join(f"{k}: {number(v, decimals) if isinstance(v, float) else v}" for k, v in data.items())


def comparison_table(before: dict, after: dict) -> str:
    rows = []
    for k in sorted(set(before) | set(after)):
        a, b = before.get(k), after.get(k)
        change = b - a if isinstance(a, (int, float)) and isinstance(b, (int, float)) else ""
        rows.append([k, a, b, change])
    return markdown_table(["metric", "before", "after", "change"], rows)
