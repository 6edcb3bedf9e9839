"""The Markdown files of a whole project: imports, feeds, audits, evidence, decisions, explanations, and what was checked.

Each writer takes results that are summaries, and renders them on the driver; no observations are collected.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import evidence, explain, quality, reports
from marketloom.sources import files, settings


def _status(one: DataFrame) -> dict[str, object]:
    return one.first().asDict()


def source_health(path: str, health: DataFrame) -> Path:
    return reports.markdown(path, "Feed health", {}, {"Sources": (health, ["source_id"])})


def fetch_status(path: str, status: DataFrame) -> Path:
    return reports.markdown(path, "Feed fetch", {}, {"Sources": (status, ["source_id"])})


def alias_matches(path: str, summary: DataFrame) -> Path:
    return reports.markdown(path, "Alias matches", {}, {"Items": (summary, ["entity"])})


def context_sources(path: str, rows: DataFrame, most: int = 20) -> Path:
    """The entities with the most news."""
    active = rows.filter(F.coalesce(F.col("news_count").cast("long"), F.lit(0)) > 0)
    facts = {"rows": rows.count(), "active rows": active.count()}
    top = active.orderBy(F.desc("news_count"), "entity_type", "entity_id").limit(most)
    return reports.markdown(path, "News context", facts, {"Entities": (top, ["entity_type", "entity_id"])})


def fetched_rows(path: str, title: str, rows: DataFrame, failed: DataFrame, key: str) -> Path:
    """What providers gave, and what failed."""
    counts = rows.groupBy(key).agg(F.count("*").alias("rows"))
    status = "ready_with_rows" if rows.limit(1).count() else "no_rows"
    return reports.markdown(path, title, {"status": status}, {"Rows": (counts, [key]), "Failures": (failed, failed.columns[:1])})


def market_audit(path: str, audit: DataFrame, issues: DataFrame) -> Path:
    counts = audit.groupBy("status").count()
    return reports.markdown(path, "Market data", {}, {"Status": (counts, ["status"]), "Symbols": (audit, ["symbol"]), "Issues": (issues, ["symbol", "code"])})


def fundamentals_status(path: str, valid: DataFrame, rejected: DataFrame, coverage: DataFrame, decision: str | None = None) -> Path:
    bad = rejected.select("ticker", "period_end", F.array_join("errors", "; ").alias("errors"))
    return reports.markdown(path, "Fundamentals import", _status(quality.fundamentals_readiness(valid, rejected, decision)), {"Coverage": (coverage, ["ticker"]), "Rejected rows": (bad, ["ticker", "period_end"])})


def macro_status(path: str, valid: DataFrame, rejected: DataFrame, indicators: Iterable[str], decision: str | None = None) -> Path:
    macro = valid.filter("context_type = 'macro'")
    bad = rejected.select("context_id", F.array_join("errors", "; ").alias("errors"))
    coverage = quality.macro_coverage(macro, "indicator", "publication_timestamp")
    return reports.markdown(path, "Macro import", _status(quality.macro_readiness(valid, rejected, indicators, decision)), {"Indicators": (coverage, ["indicator"]), "Rejected rows": (bad, ["context_id"])})


def evidence_gate(path: str, bundle: DataFrame, features: list[str], least: int = 1) -> Path:
    facts = _status(evidence.gate(bundle, features, least)) | _status(evidence.commit(bundle))
    codes = evidence.gate_issues(bundle, features, least).groupBy("severity", "code").count()
    return reports.markdown(path, "Evidence and gate", facts, {"Issues": (codes, ["severity", "code"])})


def decision_log(path: str, replayed: DataFrame) -> Path:
    return reports.markdown(path, "Decisions", {}, {"Replay": (replayed.groupBy("replay_status").count(), ["replay_status"])})


def harness_variants(path: str, variants: DataFrame) -> Path:
    return reports.markdown(path, "Harness variants", {}, {"Variants": (variants, ["variant"])})


def symbol(path: str, analyses: DataFrame, name: str) -> Path:
    """One symbol's analysis; a symbol outside the universe is an error."""
    row = analyses.filter(F.col("symbol") == name).first()
    if row is None:
        raise ValueError(f"not in the universe: {name}")
    return reports.markdown(path, name, row.asDict(), {})


def research_status(path: str, counts: dict[str, int], missing: DataFrame, errors: Iterable[str] = ()) -> Path:
    """Rows of each study, symbols without prices, and what went wrong."""
    facts = counts | {f"error {n}": e for n, e in enumerate(errors, 1)}
    return reports.markdown(path, "Research run", facts, {"Symbols without prices": (missing, ["symbol"])})


def requirements(path: str, covered: dict[str, str]) -> Path:
    """Which report answers which requirement."""
    return reports.markdown(path, "Requirements", covered, {})


def final(path: str, root: str, entries: list[dict[str, str]]) -> Path:
    """Status of all reports, with what their manifest lacks."""
    issues = reports.manifest_issues(entries, root)
    lines = ["# Reports as a whole", "", *[f"- {e.get('path', '')}: {e.get('status', '')}" for e in entries], "", "## Open", "", *([f"- {i}" for i in issues] or ["Nothing."]), "", reports.LIMITS, ""]
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("\n".join(lines), encoding="utf-8")
    return out


def explanation(folder: str, name: str, answer: dict, known: set[str]) -> tuple[Path, Path, list[str]]:
    """An explanation as Markdown and JSON, and what its contract lacks."""
    issues = explain.contract_issues(answer, known)
    safe = reports.safe_name(name)
    one, two = Path(folder) / f"{safe}.md", Path(folder) / f"{safe}.json"
    one.parent.mkdir(parents=True, exist_ok=True)
    one.write_text("\n".join([f"# {name}", "", *[f"- {k}: {reports.shown(v)}" for k, v in answer.items()], "", *[f"- issue: {i}" for i in issues], reports.LIMITS, ""]), encoding="utf-8")
    two.write_text(json.dumps({"answer": answer, "issues": issues}, sort_keys=True, ensure_ascii=False), encoding="utf-8")
    return one, two, issues


def offline_checks(spark, settings_path: str, universe_path: str, prices_path: str, root: str, entries: list[dict[str, str]], strict: bool = False) -> list[tuple[str, str, str]]:
    """(check, pass, warning or fail, detail) of what a run without a network needs."""
    out: list[tuple[str, str, str]] = []

    def check(name: str, work, soft: bool = False) -> None:
        try:
            out.append((name, "pass", str(work())))
        except Exception as e:  # noqa: BLE001  whatever is wrong is what the check reports
            out.append((name, "warning" if soft else "fail", f"{type(e).__name__}: {str(e).splitlines()[0]}"))

    def universe() -> str:
        bad = files.universe_issues(members, size).collect()
        if bad:
            raise ValueError("; ".join(f"{r.code} {r.subject}" for r in bad[:5]))
        return f"{size} members"

    def prices() -> str:
        lost = files.missing_symbols(members, files.prices(spark, prices_path)).count()
        if lost:
            raise ValueError(f"{lost} symbols without prices")
        return "all symbols have prices"

    def manifest() -> str:
        if found := reports.manifest_issues(entries, root):
            raise ValueError("; ".join(found[:5]))
        return f"{len(entries)} reports"

    check("settings", lambda: settings.load(settings_path))
    size = settings.load(settings_path).universe_size if out[-1][1] == "pass" else settings.Settings().universe_size
    members = files.optional(files.universe, spark, universe_path)
    check("universe", universe)
    check("prices", prices, soft=not strict)
    check("reports", manifest)
    return out


def demo(path: str, checks: list[tuple[str, str, str]]) -> tuple[Path, int]:
    """The checks as a file, and the exit code: 1 if any failed."""
    lines = ["# Offline checks", "", "| check | status | detail |", "| --- | --- | --- |", *[f"| {n} | {s} | {reports.shown(d)} |" for n, s, d in checks], ""]
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("\n".join(lines), encoding="utf-8")
    return out, int(any(s == "fail" for _, s, _ in checks))
