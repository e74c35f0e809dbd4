"""Detection rules: declarative data, validated here and compiled to Columns."""

from tripline.rules.model import MatchRule, RuleError, ThresholdRule, parse_rule
from tripline.rules.load import enabled_rules, load_rules

__all__ = ["MatchRule", "RuleError", "ThresholdRule", "enabled_rules", "load_rules", "parse_rule"]
