"""Settings of a study and feed sources, read from a YAML subset (maps, lists, scalars, inline lists)."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


def _scalar(s: str):
    s = s.strip()
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s in ("", "null", "~"):
        return None
    if s in ("true", "false"):
        return s == "true"
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            continue
    return s


def _bare(line: str) -> str:
    """A line without its comment; a number sign inside quotes is none."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
    return line.rstrip()


def parse(text: str) -> dict:
    """Nested maps, lists of scalars and lists of maps, by indentation."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in map(_bare, text.splitlines()) if x.strip()]
    at = 0

    def block(indent: int):
        nonlocal at
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] >= indent:
            depth, body = lines[at]
            if depth > indent:
                raise ValueError(f"unexpected indentation: {body!r}")
            if body == "-" or body.startswith("- "):
                if not isinstance(out, list | None):
                    raise ValueError(f"a list inside a map: {body!r}")
                out = [] if out is None else out
                item = body[1:].strip()
                if ":" in item and item.partition(":")[2][:1] in ("", " "):
                    lines[at] = (indent + 2, item)  # the item is a map that begins on the dash's line
                    out.append(block(indent + 2))
                else:
                    at += 1
                    out.append(_scalar(item) if item else block(lines[at][0]) if at < len(lines) and lines[at][0] > indent else None)
                continue
            key, sep, value = body.partition(":")
            if not sep or not isinstance(out, dict | None):
                raise ValueError(f"not a mapping: {body!r}")
            out = {} if out is None else out
            at += 1
            if value.strip():
                out[_scalar(key)] = _scalar(value)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
                out[_scalar(key)] = block(lines[at][0])
            else:
                out[_scalar(key)] = None
        return out

    found = block(lines[0][0]) if lines else {}
    if not isinstance(found, dict):
        raise ValueError("the settings are no map")
    return found


@dataclass(frozen=True)
class FeedSource:
    source_id: str
    url: str
    language: str
    category: str


def feed_sources(path: str) -> tuple[FeedSource, ...]:
    """The enabled feeds of a settings file. A feed without one of its fields, or no feed at all, is an error."""
    rows = parse(Path(path).read_text(encoding="utf-8")).get("sources") or []
    out = []
    for n, row in enumerate(rows, 1):
        values = [str(row.get(k) if row.get(k) is not None else "").strip() for k in ("id", "url", "language", "category")]
        if not all(values):
            raise ValueError(f"feed {n} lacks a field")
        if row.get("enabled", True):
            out.append(FeedSource(*values))
    if not rows:
        raise ValueError("no feeds are configured")
    return tuple(out)


@dataclass(frozen=True)
class Settings:
    trading_cost_bps: float = 10.0
    slippage_bps: float = 5.0
    horizons: tuple[int, ...] = (1, 3, 5, 10, 20)
    unseen_start_date: str | None = None
    regime_lookback_days: int = 20
    universe_size: int = 30
    small_sample: int = 20
    disclosure_lag_days: int = 40

    def __post_init__(self) -> None:
        if not self.horizons or any(h < 1 for h in self.horizons):
            raise ValueError("horizons must be positive")
        if self.trading_cost_bps < 0 or self.slippage_bps < 0:
            raise ValueError("costs must not be negative")


def load(path: str) -> Settings:
    d = parse(Path(path).read_text(encoding="utf-8"))
    b, e, v, f = (d.get(k) or {} for k in ("backtest", "experiment", "validation", "fundamentals"))
    base = Settings()
    return Settings(
        float(b.get("trading_cost_bps", base.trading_cost_bps)), float(b.get("slippage_bps", base.slippage_bps)), tuple(b.get("horizons", base.horizons)), e.get("unseen_start_date"),
        int(e.get("regime_lookback_days", base.regime_lookback_days)), int(v.get("expected_universe_size", base.universe_size)), int(v.get("warn_on_small_sample_below", base.small_sample)), int(f.get("synthetic_disclosure_lag_days", base.disclosure_lag_days)),
    )
