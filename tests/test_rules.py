import json

import pytest
from builders import event, events
from pyspark.sql import functions as F

from tripline.operators.selection import selection
from tripline.rules import RuleError, enabled_rules, load_rules, parse_rule
from tripline.rules.regex import java_pattern

THRESHOLD = {"type": "threshold", "key": "k", "name": "n", "window_seconds": 60, "threshold": 5}
MATCH = {"type": "match", "key": "k", "name": "n", "field": "raw.path", "patterns": ["a"]}


def test_shipped_rules_load_in_file_order():
    assert [r.key for r in load_rules()] == ["brute_force_ssh", "http_dos", "port_scan", "sqli_probe"]


@pytest.mark.parametrize(
    "change",
    [
        {"type": "other"},
        {"window_seconds": 0},
        {"threshold": 0},
        {"threshold": 1.5},
        {"severity": "urgent"},
        {"name": None},
        {"selection": ["x"]},
    ],
)
def test_bad_threshold_rules(change):
    with pytest.raises(RuleError):
        parse_rule({**THRESHOLD, **change})


@pytest.mark.parametrize("change", [{"patterns": []}, {"patterns": ["("]}, {"decode": "html"}, {"patterns": None}])
def test_bad_match_rules(change):
    with pytest.raises(RuleError):
        parse_rule({**MATCH, **change})


def test_missing_entries_are_reported():
    with pytest.raises(RuleError, match="threshold"):
        parse_rule({k: v for k, v in THRESHOLD.items() if k != "threshold"})


def test_disabled_rules_are_skipped(tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({**THRESHOLD, "key": "b"}))
    (tmp_path / "a.yml").write_text("type: match\nkey: a\nname: n\nfield: raw.path\npatterns: [x]\nenabled: false\n")
    assert [r.key for r in load_rules(tmp_path)] == ["a", "b"]
    assert [r.key for r in enabled_rules(tmp_path)] == ["b"]


@pytest.mark.parametrize(
    ("pattern", "text", "expected"),
    [
        (r"(?i)union\s+select", "UNION Select", True),
        (r"a\sb", "a\x1cb", True),
        (r"a\Sb", "a\x1cb", False),
        (r"[\s]x", "\x1fx", True),
        (r"(?P<my_q>['\"])x(?P=my_q)", "'x'", True),
        (r"(?P<my_q>['\"])x(?P=my_q)", "'x\"", False),
        (r"[[]&&]", "[&&]", True),
        (r"x{,2}y$", "xxy", True),
        (r"end\Z", "end", True),
        (r"\bé", "aé", False),
        (r"[]a]", "]", True),
    ],
)
def test_patterns_mean_the_same_in_java(spark, pattern, text, expected):
    row = spark.range(1).select(F.lit(text).rlike(java_pattern(pattern)).alias("hit")).first()
    assert row.hit is expected


@pytest.mark.parametrize("pattern", [r"(a)?(?(1)b|c)", r"(?a)\w"])
def test_untranslatable_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


@pytest.mark.parametrize(
    ("wanted", "expected"),
    [
        ({}, {"0", "1", "2"}),
        ({"protocol": "ssh"}, {"0"}),
        ({"protocol": ["ssh", "http"]}, {"0", "1"}),
        ({"protocol": None}, {"2"}),
        ({"protocol": ["ssh", None]}, {"0", "2"}),
        ({"raw.status": 404}, {"1"}),
        ({"raw.status": 404.0}, {"1"}),
        ({"raw.status": "404"}, set()),
        ({"raw.path": 404}, set()),
        ({"raw.nothing.here": None}, {"0", "1", "2"}),
        ({"raw.nothing": "x"}, set()),
        ({"raw.alert.severity": 2}, {"2"}),
        ({"raw.status.deeper": None}, {"0", "1", "2"}),
        ({"protocol": "http", "raw.path": "/"}, {"1"}),
    ],
)
def test_selection(spark, wanted, expected):
    data = events(
        spark,
        [
            event(0, "1.1.1.1", "ssh", outcome="failed"),
            event(1, "1.1.1.1", "http", status=404, path="/"),
            event(2, "1.1.1.1", None, alert={"signature": "s", "signature_id": 1, "category": "c", "severity": 2}),
        ],
    )
    hit = selection(data.schema, wanted)
    assert {r.event_id for r in data.where(hit).collect()} == expected
    assert data.where(hit.isNull()).count() == 0
