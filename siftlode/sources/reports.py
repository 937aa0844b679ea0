"""Reports of small results: Markdown tables, and JSON beside them. Driver-side, never for tables of a corpus's size."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows that a report may have; more is an error, not a cut.
MOST = 1000


def _cell(value: object) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    return f"{value:.4f}" if isinstance(value, float) else str(value).replace("|", "\\|").replace("\n", " ")


def table(rows: DataFrame | Sequence[Mapping[str, object]], columns: Sequence[str] | None = None) -> str:
    """A Markdown table of at most MOST rows."""
    if isinstance(rows, DataFrame):
        columns = columns or rows.columns
        rows = [r.asDict() for r in rows.select(*columns).limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"a report of more than {MOST} rows")
    columns = list(columns or (rows[0] if rows else []))
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(_cell(r[c]) for c in columns) + " |" for r in rows])


def write(path: str, title: str, sections: Mapping[str, DataFrame | Sequence[Mapping[str, object]]], facts: Sequence[object] = ()) -> None:
    """``path``.md with a table a section and the facts checked, and ``path``.json with the facts."""
    parts = [f"# {title}"] + [f"## {name}\n\n{table(rows)}" for name, rows in sections.items()]
    checked = [{"name": f.name, "expected": f.expected, "found": f.found, "ok": f.ok} for f in facts]
    if checked:
        parts.append("## Facts\n\n" + table(checked))
    Path(f"{path}.md").write_text("\n\n".join(parts) + "\n", encoding="utf-8")
    Path(f"{path}.json").write_text(json.dumps({"title": title, "facts": checked}, ensure_ascii=False, indent=1) + "\n", encoding="utf-8")
