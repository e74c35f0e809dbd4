"""Rule files: small driver-side configuration."""

from __future__ import annotations

import json
from pathlib import Path

from tripline.rules.model import Rule, RuleError, parse_rule

try:
    import yaml
except ImportError:  # YAML files then cannot be read; JSON ones still can.
    yaml = None

SHIPPED = Path(__file__).parent / "shipped"


def load_rules(directory: str | Path | None = None) -> list[Rule]:
    """Every ``*.yml`` (or ``*.json``) file of a directory, in file-name order."""
    folder = Path(directory) if directory else SHIPPED
    files = [p for p in folder.iterdir() if p.suffix in (".yml", ".json")]
    return [parse_rule(_read(path)) for path in sorted(files)]


def enabled_rules(directory: str | Path | None = None) -> list[Rule]:
    return [rule for rule in load_rules(directory) if rule.enabled]


def _read(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    if yaml is None:
        raise RuleError(f"{path.name}: PyYAML is needed to read YAML rules")
    return yaml.safe_load(text)
