"""Output formats for a bounded number of rows."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame

FORMS = ("csv", "json", "jsonlines", "markdown", "box", "table", "line", "column", "list", "tabs", "html", "latex", "insert", "trash")


def _text(v) -> str:
    if v is None:
        return ""
    if hasattr(v, "asDict"):
        return json.dumps(v.asDict(True), default=str)
    return str(v)


def render(df: DataFrame, form: str = "box", limit: int = 1000, table: str = "result") -> str:
    if form not in FORMS:
        raise ValueError(f"no format {form}")
    names = df.columns
    rows = [tuple(r) for r in df.limit(limit).collect()]
    cells = [[_text(v) for v in r] for r in rows]
    if form == "trash":
        return ""
    if form in ("csv", "tabs"):
        out = io.StringIO()
        csv.writer(out, delimiter="," if form == "csv" else "\t", lineterminator="\n").writerows([names, *cells])
        return out.getvalue()
    if form in ("json", "jsonlines"):
        own = [json.dumps({n: v.asDict(True) if hasattr(v, "asDict") else v for n, v in zip(names, r, strict=True)}, default=str) for r in rows]
        return "[" + ",\n".join(own) + "]" if form == "json" else "\n".join(own)
    if form == "list":
        return "\n".join("|".join(r) for r in [names, *cells])
    if form == "line":
        wide = max(map(len, names), default=0)
        return "\n\n".join("\n".join(f"{n:>{wide}} = {v}" for n, v in zip(names, r, strict=True)) for r in cells)
    if form == "markdown":
        return "\n".join("| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in [names, ["---"] * len(names), *cells])
    if form == "html":
        head = "<tr>" + "".join(f"<th>{html.escape(n)}</th>" for n in names) + "</tr>"
        return "<table>" + head + "".join("<tr>" + "".join(f"<td>{html.escape(v)}</td>" for v in r) + "</tr>" for r in cells) + "</table>"
    if form == "latex":
        body = " \\\\\n".join(" & ".join(x.replace("&", "\\&").replace("_", "\\_") for x in r) for r in [names, *cells])
        return f"\\begin{{tabular}}{{{'l' * len(names)}}}\n{body} \\\\\n\\end{{tabular}}"
    if form == "insert":
        quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + _text(v).replace("'", "''") + "'"
        return "\n".join(f"INSERT INTO {table} VALUES ({', '.join(map(quote, r))});" for r in rows)
    wide = [max(len(x) for x in col) for col in zip(names, *cells, strict=True)] if names else []
    line = lambda r, sep: sep.join(f"{x:<{w}}" for x, w in zip(r, wide, strict=True))
    if form == "column":
        return "\n".join([line(names, "  "), "  ".join("-" * w for w in wide), *(line(r, "  ") for r in cells)])
    bar = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    return "\n".join([bar, f"| {line(names, ' | ')} |", bar, *(f"| {line(r, ' | ')} |" for r in cells), bar])
