"""The analysis harness: eleven states in order, tools by state, a gate, a reviewed and saved decision."""

from __future__ import annotations

from dataclasses import dataclass, field

from marketloom.operators.evidence import STATES, TOOLS, permitted

#: What an analysis may be called.
LABELS = ("POTENTIAL_CATCH_UP_CANDIDATE", "INVESTIGATE", "INCONCLUSIVE_DATA_GAP", "ANALYSIS_UNSAFE")


@dataclass
class Harness:
    """Runs on the driver; what it did is ``log``, which ``evidence.conformance`` can check at any size."""

    tools: object = None
    state: str = STATES[0]
    verdict: str | None = None
    label: str | None = None
    reviewed: str | None = None
    saved: bool = False
    log: list[dict] = field(default_factory=list)

    def _say(self, what: str, status: str, message: str) -> tuple[str, str]:
        self.log.append({"state": self.state, "event": what, "status": status, "message": message})
        return status, message

    def call(self, tool: str, **args):
        if not permitted(self.state, tool):
            return self._say("tool_blocked", "error", f"{self.state} has no tool {tool}")
        answer = self.tools.call(tool, **args) if self.tools else None
        self._say("tool_called", "ok" if answer is None else answer["status"], f"tool {tool}")
        return answer

    def advance(self, expected: str | None = None) -> tuple[str, str]:
        if expected is not None and expected != self.state:
            return self._say("advance_blocked", "error", f"{expected} was to be completed, but {self.state} is open")
        if self.state == STATES[-1]:
            return self._say("advance_blocked", "warning", "no state follows")
        before, self.state = self.state, STATES[STATES.index(self.state) + 1]
        return self._say("advanced", "ok", f"{before} is done, {self.state} begins")

    def apply_gate(self, verdict: str) -> tuple[str, str]:
        if self.state != "risk_gate":
            return self._say("gate_blocked", "error", "the gate belongs to risk_gate")
        self.verdict = verdict
        if verdict == "ANALYSIS_UNSAFE":
            self.label = "ANALYSIS_UNSAFE"
        return self._say("gate_applied", "ok", verdict)

    def set_label(self, label: str) -> tuple[str, str]:
        if self.state != "explain" or label not in LABELS or self.verdict is None:
            return self._say("label_blocked", "error", f"label {label} can't be set now")
        self.label = "ANALYSIS_UNSAFE" if self.verdict == "ANALYSIS_UNSAFE" else label
        return self._say("label_set", "ok", self.label)

    def review(self, status: str) -> tuple[str, str]:
        if self.state != "human_review":
            return self._say("review_blocked", "error", "a review belongs to human_review")
        self.reviewed = status
        return self._say("reviewed", "ok", status)

    def save(self) -> tuple[str, str]:
        if self.state != "save_decision" or not (self.label and self.verdict and self.reviewed):
            return self._say("save_blocked", "error", "a decision needs a gate, a label and a review")
        self.saved = True
        return self._say("saved", "ok", self.label)


__all__ = ["Harness", "LABELS", "STATES", "TOOLS"]
