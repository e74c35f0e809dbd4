"""The two rule shapes and their validation."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from typing import Any

from tripline.schemas import SEVERITIES


class RuleError(ValueError):
    """A rule that does not have one of the two shapes."""


@dataclass(frozen=True)
class MatchRule:
    """Fires once per event whose ``field`` matches any of ``patterns``."""

    key: str
    name: str
    field: str
    patterns: tuple[str, ...]
    selection: dict[str, Any] = field(default_factory=dict)
    decode: str | None = None
    description: str | None = None
    severity: str = "medium"
    mitre_technique: str | None = None
    enabled: bool = True

    @property
    def type(self) -> str:
        return "match"


@dataclass(frozen=True)
class ThresholdRule:
    """Fires once per key with at least ``threshold`` events (or distinct
    values of ``distinct_field``) in the key's latest ``window_seconds``."""

    key: str
    name: str
    window_seconds: int
    threshold: int
    selection: dict[str, Any] = field(default_factory=dict)
    group_by: str = "source_ip"
    distinct_field: str | None = None
    description: str | None = None
    severity: str = "medium"
    mitre_technique: str | None = None
    enabled: bool = True

    @property
    def type(self) -> str:
        return "threshold"


Rule = MatchRule | ThresholdRule

_TEXT = ("key", "name", "field", "group_by")
_OPTIONAL_TEXT = ("description", "mitre_technique", "distinct_field")


def parse_rule(data: dict[str, Any]) -> Rule:
    """Validate one rule mapping; unknown entries are ignored."""
    if not isinstance(data, dict):
        raise RuleError(f"a rule must be a mapping, got {type(data).__name__}")
    kinds = {"match": MatchRule, "threshold": ThresholdRule}
    kind = kinds.get(data.get("type"))
    if kind is None:
        raise RuleError(f"rule type must be 'match' or 'threshold', got {data.get('type')!r}")

    known = {k: v for k, v in data.items() if k in kind.__dataclass_fields__}
    label = data.get("key", "?")
    for name in _TEXT:
        if name in known and not isinstance(known[name], str):
            raise RuleError(f"{label}: {name} must be text")
    for name in _OPTIONAL_TEXT:
        if known.get(name) is not None and not isinstance(known[name], str):
            raise RuleError(f"{label}: {name} must be text")
    if not isinstance(known.get("selection", {}), dict):
        raise RuleError(f"{label}: selection must be a mapping")
    if known.get("severity", "medium") not in SEVERITIES:
        raise RuleError(f"{label}: unknown severity {known['severity']!r}")
    if not isinstance(known.get("enabled", True), bool):
        raise RuleError(f"{label}: enabled must be true or false")
    if kind is MatchRule:
        known["patterns"] = _patterns(label, known.get("patterns"))
        if known.get("decode") not in (None, "url"):
            raise RuleError(f"{label}: decode must be 'url' when given")
    else:
        known["window_seconds"] = _whole(label, "window_seconds", known.get("window_seconds"))
        known["threshold"] = _whole(label, "threshold", known.get("threshold"))
    try:
        return kind(**known)
    except TypeError as exc:
        raise RuleError(f"{label}: {exc}") from None


def definition(rule: Rule) -> dict[str, Any]:
    """The full rule body, as stored in the rule table."""
    return {"type": rule.type, **asdict(rule)}


def _patterns(label: str, patterns: Any) -> tuple[str, ...]:
    if not isinstance(patterns, (list, tuple)) or not patterns:
        raise RuleError(f"{label}: at least one pattern is required")
    for pattern in patterns:
        try:
            re.compile(pattern)
        except (re.error, TypeError) as exc:
            raise RuleError(f"{label}: bad pattern {pattern!r}: {exc}") from None
    return tuple(patterns)


def _whole(label: str, name: str, value: Any) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise RuleError(f"{label}: {name} must be a whole number") from None
    if number < 1 or number != float(value):
        raise RuleError(f"{label}: {name} must be a whole number of at least 1")
    return number
