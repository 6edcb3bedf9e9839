"""Markdown and HTML reports. Only summaries are collected, and never more than ``most`` rows of one."""

from __future__ import annotations

import html
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LIMITS = "Historical research only, not investment advice."


def shown(v) -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v).replace("|", "\\|").replace("\n", " ")


def table(df: DataFrame, order: list[str] | None = None, most: int = 200) -> list[str]:
    """Lines of a Markdown table; a longer summary says how it goes on."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    lines += ["| " + " | ".join(shown(v) for v in r) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\nOnly the first {most} rows are shown.")
    return lines


def markdown(path: str, title: str, facts: dict[str, object], tables: dict[str, tuple[DataFrame, list[str]]]) -> Path:
    lines = [f"# {title}", "", *[f"- {k}: {shown(v)}" for k, v in facts.items()], ""]
    for name, (df, order) in tables.items():
        lines += [f"## {name}", "", *table(df, order), ""]
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("\n".join([*lines, LIMITS, ""]), encoding="utf-8")
    return out


def dashboard(path: str, title: str, tables: dict[str, DataFrame], most: int = 100) -> Path:
    """A static page with one section per summary."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(shown(v))}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
        parts.append(f"<section><h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table></section>")
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("".join([*parts, f"<p>{LIMITS}</p></body></html>"]), encoding="utf-8")
    return out


def run_status(trade_count: int, warnings: int = 0, signal_count: int | None = None) -> str:
    """measured, measured_partial with warnings, no_trades from signals, inconclusive where there was nothing to trade."""
    if trade_count:
        return "measured_partial" if warnings else "measured"
    return "inconclusive" if signal_count == 0 else "no_trades"


def scanned_tables(spark: SparkSession, path: str) -> DataFrame:
    """All Markdown tables of a report: (heading, row, cells), cells by column name; the row below a header counts as 1."""
    rows, heading, names, n = [], "", None, 0
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if line.startswith("#"):
            heading, names = line.lstrip("# ").strip(), None
        elif line.startswith("|"):
            cells = [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]
            if names is None:
                names, n = cells, 0
            elif not all(re.fullmatch(":?-+:?", c) for c in cells):
                n += 1
                rows.append((heading, n, dict(zip(names, cells, strict=False))))
        else:
            names = None
    return spark.createDataFrame(rows, "heading string, row int, cells map<string,string>")


#: What a manifest says of each report.
MANIFEST = ("path", "status", "data_period", "source", "sample_size", "assumptions", "limitations")


def manifest_issues(entries: list[dict[str, str]], root: str) -> list[str]:
    """Reports that aren't there, and fields that say nothing."""
    out = []
    for e in entries:
        if not (Path(root) / e.get("path", "")).is_file():
            out.append(f"{e.get('path', '')}: no such report")
        out += [f"{e.get('path', '')}: {k} is empty" for k in MANIFEST if not str(e.get(k, "")).strip()]
    return out


def index(path: str, entries: list[dict[str, str]]) -> Path:
    """The list of all reports."""
    lines = ["# Reports", "", "| " + " | ".join(MANIFEST) + " |", "| " + " | ".join("---" for _ in MANIFEST) + " |"]
    lines += ["| " + " | ".join(shown(e.get(k)) for k in MANIFEST) + " |" for e in entries]
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("\n".join([*lines, ""]), encoding="utf-8")
    return out


def percent(v: float | None) -> str:
    return "n/a" if v is None else f"{100 * v:.2f}%"


def safe_name(symbol: str) -> str:
    """A symbol as part of a file name."""
    return re.sub("[^A-Za-z0-9_-]", "_", symbol)


def without_colour(text: str) -> str:
    """Terminal colours taken out."""
    return re.sub("\x1b\\[[0-9;]*[A-Za-z]", "", text)
