"""Explanations of a gated analysis: an offline writer, and the contract that any writer's answer must meet."""

from __future__ import annotations

import json
import re

from marketloom.operators.harness import LABELS

FIELDS = ("label", "summary", "evidence_ids", "limitations")
COMMAND = re.compile(r"^\s*(?:please\s+)?(?:analy[sz]e|explain|check)\s+([A-Za-z0-9.]+)\s*$", re.I)
FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")


def command_symbol(words: list[str] | str) -> str:
    """The symbol of a command like "Analyze ABC", or of a bare symbol."""
    text = ANSI.sub("", words if isinstance(words, str) else " ".join(words)).strip()
    m = COMMAND.match(text)
    symbol = m[1] if m else text
    if not re.fullmatch(r"[A-Za-z0-9.]+", symbol):
        raise ValueError(f"no symbol in {text!r}")
    return symbol.upper()


def parse_answer(text: str) -> dict:
    """The JSON object of an answer, fenced or bare."""
    m = FENCE.search(text)
    answer = json.loads(m[1] if m else text)
    if not isinstance(answer, dict):
        raise ValueError("an answer must be an object")
    return answer


def contract_issues(answer: dict, known_evidence: set[str]) -> list[str]:
    """What keeps an answer from being used: missing fields, unknown labels, evidence that was never committed."""
    issues = [f"{f} is missing" for f in FIELDS if not answer.get(f)]
    if answer.get("label") not in LABELS:
        issues.append(f"unknown label: {answer.get('label')}")
    issues += [f"unknown evidence: {e}" for e in answer.get("evidence_ids") or () if e not in known_evidence]
    return issues


def offline(symbol: str, label: str, evidence_ids: list[str], verdict: str) -> dict:
    """An explanation from the facts alone."""
    safe = label if verdict == "ANALYSIS_SAFE" else "ANALYSIS_UNSAFE"
    return {"label": safe, "summary": f"{symbol}: {safe}, resting on {len(evidence_ids)} committed records; gate {verdict}.", "evidence_ids": evidence_ids, "limitations": "Historical research only, not investment advice."}
