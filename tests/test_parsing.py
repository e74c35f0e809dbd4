from datetime import datetime

import pytest
from builders import lines

from tripline.operators.parsing import (
    ParseOptions,
    accepted,
    parse_lines,
    parse_mixed,
    register_format,
    sniff_files,
    sniff_groups,
    sniff_paths,
    supported_formats,
    to_events,
)
from tripline.sources.lines import read_lines, to_lines
from tripline.workload import adapters

OPTIONS = ParseOptions(datetime(2026, 6, 10, 12, 0, 0), year=2024)
SSH = "Feb  3 04:05:06 bastion-2 sshd[77]: Failed password for deploy from 172.20.4.13 port 40022 ssh2"
WEB = '172.20.4.14 - - [05/Jan/2025:06:07:08 +0000] "HEAD /feed.xml HTTP/1.0" 410 71 "-" "reader/2"'
EVE = (
    '{"timestamp":"2025-02-07T08:09:10.250000+0000","event_type":"alert","src_ip":"172.20.4.15","src_port":51515,'
    '"dest_ip":"10.77.0.9","dest_port":8443,"proto":"TCP","alert":{"signature":"odd client hello","signature_id":7,"severity":2}}'
)


def parse_all(spark, source_type, *texts):
    return parse_lines(lines(spark, *texts), source_type, OPTIONS).collect()


def parse_one(spark, source_type, text):
    return parse_all(spark, source_type, text)[0]


def set_fields(row):
    raw = row.raw.asDict(recursive=True)
    return {k: v for k, v in raw.items() if v is not None}


def test_auth_failed_password(spark):
    row = parse_one(spark, "auth_log", SSH)
    assert (row.source_ip, row.protocol, row.ts) == ("172.20.4.13", "ssh", datetime(2024, 2, 3, 4, 5, 6))
    assert set_fields(row) == {"outcome": "failed", "username": "deploy", "source_port": 40022, "service": "sshd"}


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("Failed password for invalid user admin from 1.2.3.4 port 5 ssh2", ("invalid_user", "admin", 5)),
        ("Failed password for invalid from 1.2.3.4 port 5 ssh2", ("failed", "invalid", 5)),
        ("Accepted password for alice from 1.2.3.4 port 5 ssh2", ("accepted", "alice", 5)),
        ("Invalid user oracle from 1.2.3.4", ("invalid_user", "oracle", None)),
        ("Invalid user oracle from 1.2.3.4 port 9", ("invalid_user", "oracle", None)),
    ],
)
def test_auth_messages(spark, message, expected):
    row = parse_one(spark, "auth_log", f"Oct  1 13:55:33 h sshd[1]: {message}")
    assert (row.raw.outcome, row.raw.username, row.raw.source_port) == expected
    assert row.ts == datetime(2024, 10, 1, 13, 55, 33)


@pytest.mark.parametrize(
    "text",
    [
        "Feb  3 04:05:07 bastion-2 cron[9]: job done",
        "Oct 10 13:56:05 bastion-2 sshd[1]: Connection closed by 1.2.3.4",
        "Oct 10 13:56 bastion-2 sshd[1]: Invalid user a from 1.2.3.4",
        "x " + SSH,
    ],
)
def test_auth_skips(spark, text):
    assert parse_one(spark, "auth_log", text).recognized is None


def test_access_combined(spark):
    row = parse_one(spark, "nginx", WEB)
    assert (row.source_ip, row.protocol, row.ts) == ("172.20.4.14", "http", datetime(2025, 1, 5, 6, 7, 8))
    assert set_fields(row) == {
        "method": "HEAD",
        "path": "/feed.xml",
        "http_version": "HTTP/1.0",
        "status": 410,
        "size": 71,
        "referer": "-",
        "user_agent": "reader/2",
    }


@pytest.mark.parametrize(
    ("old", "new", "field", "expected"),
    [
        (" 71 ", " - ", "size", None),
        (' "-" "reader/2"', "", "user_agent", None),
        (' "-" "reader/2"', ' "" ""', "user_agent", ""),
        (' "-" "reader/2"', " trailing", "referer", None),
        ("/feed.xml HTTP/1.0", "/p?id=1 OR 1=1 HTTP/1.1", "http_version", "OR 1=1 HTTP/1.1"),
    ],
)
def test_access_variants(spark, old, new, field, expected):
    row = parse_one(spark, "apache", WEB.replace(old, new))
    assert row.recognized and row.raw[field] == expected


def test_access_offset(spark):
    assert parse_one(spark, "nginx", WEB.replace("+0000", "+0130")).ts == datetime(2025, 1, 5, 4, 37, 8)


def test_eve(spark):
    row = parse_one(spark, "suricata", EVE)
    assert (row.source_ip, row.dest_ip, row.protocol) == ("172.20.4.15", "10.77.0.9", "tcp")
    assert row.ts == datetime(2025, 2, 7, 8, 9, 10, 250000)
    assert set_fields(row) == {
        "event_type": "alert",
        "src_port": 51515,
        "dest_port": 8443,
        "alert": {"signature": "odd client hello", "signature_id": 7, "category": None, "severity": 2},
    }


@pytest.mark.parametrize("text", ["this is not json", EVE[:-3], EVE + " x", EVE + "," + EVE, "[1]", "5", '{"a":1}'])
def test_eve_skips(spark, text):
    assert parse_one(spark, "suricata", text).recognized is None


def test_eve_alert_that_is_no_object(spark):
    row = parse_one(spark, "suricata", '{"timestamp":"2025-02-07T08:09:10Z","alert":"yes","proto":""}')
    assert row.recognized and row.raw.alert is None and row.protocol is None


def test_bad_time_rejects_its_line_only(spark):
    rows = parse_all(spark, "auth_log", SSH, SSH.replace("Feb  3", "Feb 30"), "noise")
    assert [r.reject_reason for r in rows] == [None, "unreadable timestamp", None]
    kept = parse_lines(lines(spark, SSH, SSH.replace("Feb  3", "Feb 30"), "noise"), "auth_log", OPTIONS)
    assert kept.where(accepted()).count() == 1


def test_unknown_format_is_an_error(spark):
    with pytest.raises(ValueError, match="no parser"):
        parse_lines(lines(spark, "x"), "windows", OPTIONS)


def test_formats_can_be_registered(spark):
    from tripline.operators.parsing.access import parse_access

    register_format("caddy", parse_access)
    assert "caddy" in supported_formats()
    assert parse_one(spark, "caddy", WEB).recognized


def test_identical_lines_are_different_events(spark):
    rows = to_events(parse_lines(lines(spark, SSH, SSH), "auth_log", OPTIONS), OPTIONS, batch="b").collect()
    assert len({r.event_id for r in rows}) == 2


def test_mixed_formats(spark):
    df = spark.createDataFrame(
        [(SSH, "auth_log"), (WEB, "nginx"), (EVE, "suricata"), ("hello from 9.9.9.9", "custom"), (WEB, "auth_log")],
        "line string, source_type string",
    )
    rows = parse_mixed(df, OPTIONS).collect()
    assert [r.source_ip for r in rows] == ["172.20.4.13", "172.20.4.14", "172.20.4.15", "9.9.9.9", None]


def test_lines_are_split_trimmed_and_never_blank(spark):
    df = spark.createDataFrame([("a\r\n\n b\x0bc d \x1e \n",)], "text string")
    assert [r.line for r in to_lines(df, "text").collect()] == ["a", "b", "c", "d"]


def test_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"ok \xff\xfe end\n\n  \nsecond\n")
    rows = read_lines(spark, str(tmp_path)).collect()
    assert [r.line for r in rows] == ["ok �� end", "second"]
    assert {r.file_name for r in rows} == {"x.log"}


@pytest.mark.parametrize(
    ("texts", "expected"),
    [
        ([SSH], "auth_log"),
        ([WEB], "nginx"),
        ([EVE], "suricata"),
        (["", "   ", SSH], "auth_log"),
        (["just some prose that is not a log at all"], None),
        (["note"] * 24 + [SSH], "auth_log"),
        (["note"] * 25 + [SSH], None),
        (["note", ""] * 20 + [WEB, SSH], "nginx"),
        (['{"a":1}', '{"flow_id":1', WEB], "nginx"),
    ],
)
def test_sniffing(spark, tmp_path, texts, expected):
    (tmp_path / "some.log").write_text("\n".join(texts) + "\n")
    assert sniff_files(read_lines(spark, str(tmp_path))).first().source_type == expected
    assert [r.source_type for r in sniff_paths(spark, str(tmp_path)).collect()] == ([expected] if expected else [])
    numbered = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, n int, text string")
    assert sniff_groups(to_lines(numbered, "text"), "doc", "n").first().source_type == expected


def test_sniffing_over_split_files(spark, tmp_path):
    (tmp_path / "late.log").write_text("\n".join(["a long enough note"] * 24 + [SSH] * 50) + "\n")
    (tmp_path / "too_late.log").write_text("\n".join(["a long enough note"] * 25 + [SSH] * 50) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        found = sniff_files(read_lines(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.file_path.rsplit("/", 1)[1]: r.source_type for r in found} == {"late.log": "auth_log", "too_late.log": None}


def test_folder_of_several_formats(spark, tmp_path):
    import gzip

    from tripline.plans.ingest import read_any

    (tmp_path / "a b.log").write_text(SSH + "\n" + WEB + "\n")
    (tmp_path / "web.log.gz").write_bytes(gzip.compress(WEB.encode()))
    (tmp_path / "eve.json").write_text(EVE)
    (tmp_path / "misc.txt").write_text("from 9.9.9.9\n" * 30 + SSH)
    (tmp_path / "empty.log").write_text("")
    lines_ = read_any(spark, str(tmp_path))
    assert {(r.file_name.replace("%20", " "), r.source_type) for r in lines_.collect()} == {
        ("a b.log", "auth_log"),
        ("web.log.gz", "nginx"),
        ("eve.json", "suricata"),
        ("misc.txt", "custom"),
    }
    assert parse_mixed(lines_, OPTIONS).where(accepted()).count() == 1 + 1 + 1 + 31


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 10, raising=False)
    cores = spark.sparkContext.defaultParallelism
    many, few = spark.range(0, 20 * cores, 1, cores), spark.range(0, 5, 1, 2 * cores)
    assert adapters.spread(many).rdd.getNumPartitions() == 2 * cores
    assert adapters.spread(few).rdd.getNumPartitions() == 2 * cores
    assert sorted(r.id for r in adapters.spread(many).collect()) == list(range(20 * cores))
