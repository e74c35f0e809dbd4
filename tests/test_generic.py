from datetime import datetime

import pytest
from test_parsing import OPTIONS, parse_all, parse_one, set_fields

STAMP = OPTIONS.ingest_time


def fields(row):
    return {k: v.toPython() for k, v in row.raw.fields.items()}


def test_json_by_aliases(spark):
    row = parse_one(spark, "custom", '{"remote-addr":"172.20.4.8","Dport":8443,"verb":"PUT","sc status":"502","uid":"svc-17"}')
    assert (row.source_ip, row.raw.dest_port, row.raw.method) == ("172.20.4.8", 8443, "PUT")
    assert (row.raw.status, row.raw.username) == (502, "svc-17")
    assert fields(row)["remote-addr"] == "172.20.4.8"


def test_nested_json(spark):
    text = '{"flow":{"client":"100.64.3.3","server_ip":"100.64.9.1"},"auth":{"account":"ops","result":"ok"}}'
    row = parse_one(spark, "custom", text)
    assert (row.source_ip, row.dest_ip, row.raw.username, row.raw.outcome) == ("100.64.3.3", "100.64.9.1", "ops", "ok")


def test_a_line_nested_too_deeply_is_text(spark):
    deep = '{"a":' * 60_000 + "1" + "}" * 60_000
    rows = parse_all(spark, "custom", deep, '{"src":"1.1.1.1","x":[1]}')
    assert [r.source_ip for r in rows] == [None, "1.1.1.1"]
    assert rows[0].recognized and rows[0].raw.message == deep and rows[0].raw.fields is None


def test_nesting_of_any_depth_keeps_document_order(spark):
    deep = '{"z":' * 40 + '{"ip":"1.1.1.1"}' + "}" * 40
    rows = parse_all(
        spark,
        "custom",
        deep,
        '{"b":{"src":"2.2.2.2"},"a":{"src":"3.3.3.3"}}',
        '{"list":[{"y":1},{"user":"u"},[],{}],"user":"later"}',
        '{"src":{"ip":""},"remote":null,"client":"4.4.4.4"}',
    )
    assert [r.source_ip for r in rows] == ["1.1.1.1", "2.2.2.2", None, "4.4.4.4"]
    assert rows[2].raw.username == "u"
    assert set(fields(rows[2])) == {"list.0.y", "list.1.user", "user"}


def test_repeated_keys_keep_first_place_and_last_value(spark):
    rows = parse_all(spark, "custom", '{"ip":"1.1.1.1","src":"2.2.2.2","ip":"3.3.3.3"}', "src=1.1.1.1 user=a src=2.2.2.2")
    assert [r.source_ip for r in rows] == ["3.3.3.3", "2.2.2.2"]
    assert fields(rows[0]) == {"ip": "3.3.3.3", "src": "2.2.2.2"}


def test_logfmt(spark):
    row = parse_one(spark, "custom", 'at=error remote_ip=172.20.4.9 account=mira reason="bad token" transport=udp')
    assert (row.source_ip, row.protocol, row.raw.username) == ("172.20.4.9", "udp", "mira")
    assert fields(row)["reason"] == "bad token"


LOGFMT = [
    ("only=one pair", None),
    ('a="q \\" r" b="open', {"a": 'q \\" r', "b": '"open'}),
    ("a.b-c=1 _d=2 9e=3", {"a.b-c": "1", "_d": "2", "e": "3"}),
    ('{"broken": a=1 b=2', {"a": "1", "b": "2"}),
    ("a=" + '"' + "x" * 20000 + '" b=2', {"a": "x" * 20000, "b": "2"}),
    ('a="' + "\\x" * 20000 + '" b=2', {"a": "\\x" * 20000, "b": "2"}),
]


@pytest.mark.parametrize(("text", "expected"), LOGFMT)
def test_logfmt_shapes(parsed, text, expected):
    row = parsed[text]
    assert (fields(row) if row.raw.fields else None) == expected
    assert (row.raw.message is None) == (expected is not None)


def test_free_text_outcome_and_time(spark):
    row = parse_one(spark, "custom", "gateway: smtp relay denied, peer 172.20.4.10, clock 2025-03-04 05:06:07")
    assert (row.source_ip, row.protocol, row.raw.outcome) == ("172.20.4.10", "smtp", "failed")
    assert row.ts == datetime(2025, 3, 4, 5, 6, 7)


def test_free_text_request(spark):
    text = 'edge-3 172.20.4.11 sent "DELETE /carts/9 HTTP/2.0" 204 in 3ms'
    row = parse_one(spark, "custom", text)
    assert row.protocol == "http"
    assert set_fields(row) == {"method": "DELETE", "path": "/carts/9", "status": 204, "message": text}


def test_never_drops_a_line(spark):
    row = parse_one(spark, "custom", "~~ *** ~~")
    assert row.recognized and row.source_ip is None and row.ts == STAMP
    assert row.raw.message == "~~ *** ~~"


ADDRESSES = [
    ("drop packets from 172.20.4.12 headed to 172.21.0.1", "172.20.4.12", "172.21.0.1"),
    ("build 777.2.3.4 is out", None, None),
    ("moved from 999.1.1.1", "999.1.1.1", None),
    ("1.1.1.1 then 2.2.2.2 then 3.3.3.3", "1.1.1.1", "2.2.2.2"),
    ("300.1.1.1 then 2.2.2.2", "2.2.2.2", None),
    ("sent TO 4.4.4.4 by 5.5.5.5", "4.4.4.4", "4.4.4.4"),
]


@pytest.mark.parametrize(("text", "source", "dest"), ADDRESSES)
def test_addresses_in_text(parsed, text, source, dest):
    row = parsed[text]
    assert (row.source_ip, row.dest_ip) == (source, dest)


WORDS = [
    ("https then ssh", "http", None),
    ("sshd2 and udp", "ssh", None),
    ("xtcp udp", "udp", None),
    ("access DENIED", None, "failed"),
    ("unauthorized", None, "failed"),
    ("rejections", None, "failed"),
    ("failing", None, None),
    ("an error_code", None, None),
    ("faıled", None, "failed"),
]


@pytest.mark.parametrize(("text", "protocol", "outcome"), WORDS)
def test_words_in_text(parsed, text, protocol, outcome):
    row = parsed[text]
    assert (row.protocol, row.raw.outcome) == (protocol, outcome)


TIMES = [
    ('{"ts":"2024-10-10T13:55:36Z"}', datetime(2024, 10, 10, 13, 55, 36)),
    ('{"ts":"2024-10-10 13:55:36.25+0200"}', datetime(2024, 10, 10, 11, 55, 36, 250000)),
    ('{"ts":"20241010T135536"}', datetime(2024, 10, 10, 13, 55, 36)),
    ('{"ts":"2024-10-10"}', datetime(2024, 10, 10)),
    ('{"ts":"2024-10-10T13:55"}', datetime(2024, 10, 10, 13, 55)),
    ('{"ts":"2024-10-10_13:55:36,5"}', datetime(2024, 10, 10, 13, 55, 36, 500000)),
    ('{"ts":"2024"}', STAMP),
    ('{"ts":"1700000000"}', STAMP),
    ('{"ts":1700000000}', datetime(2023, 11, 14, 22, 13, 20)),
    ('{"ts":1700000000123}', datetime(2023, 11, 14, 22, 13, 20, 123000)),
    ('{"ts":1e300}', STAMP),
    ('{"ts":"garbage","msg":"at 2024-01-02 03:04:05"}', datetime(2024, 1, 2, 3, 4, 5)),
    ("x [10/Oct/2024:13:55:36 +0000] y", datetime(2024, 10, 10, 13, 55, 36)),
    ("x Oct  3 13:55:36 y", datetime(2024, 10, 3, 13, 55, 36)),
    ("x 2024-13-45 13:55:36 [10/Oct/2024:13:55:37 +0000]", datetime(2024, 10, 10, 13, 55, 37)),
    ("x Feb 30 13:55:36 y", STAMP),
]


@pytest.mark.parametrize(("text", "expected"), TIMES)
def test_times(parsed, text, expected):
    assert parsed[text].ts == expected


NUMBERS = [("7", 7), ('" 7 "', 7), ("7.0", None), ("true", None), ('"+7"', 7), ('"7x"', None), ('"1_0"', 10)]


def number_text(status):
    return f'{{"status":{status}}}'


@pytest.mark.parametrize(("status", "expected"), NUMBERS)
def test_whole_numbers(parsed, status, expected):
    assert parsed[number_text(status)].raw.status == expected


@pytest.fixture(scope="module")
def parsed(spark):
    """All table texts, parsed in one job."""
    texts = [case[0] for table in (LOGFMT, ADDRESSES, WORDS, TIMES) for case in table]
    texts += [number_text(status) for status, _ in NUMBERS]
    return {row.line: row for row in parse_all(spark, "custom", *texts)}


def test_value_that_is_no_text_hides_free_text(spark):
    row = parse_one(spark, "custom", '{"src":5,"msg":"from 1.2.3.4","proto":6}')
    assert row.source_ip is None and row.protocol is None
