"""Log lines built from the events, and what the parsers must get back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.operators.parsing import accepted, parse_lines, parse_mixed, sniff_groups
from tripline.sources.lines import to_lines
from tripline.workload.adapters import BASE, OPTIONS, base, micros, spread, table
from tripline.workload.catalog import query

SECOND_SQL = "epoch_us(date_trunc('second', ts))"


def kind() -> Column:
    return F.col("event_type")


def k() -> Column:
    return F.col("k")


def port() -> Column:
    return k() + 40000


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def auth_line() -> Column:
    """All three SSH messages, lines of other programs, and impossible dates."""
    clock = F.when(F.col("event_id") % 50 == 1, text("Feb 30 ", F.date_format("ts", "HH:mm:ss"))).otherwise(
        F.date_format("ts", "MMM d HH:mm:ss")
    )
    head = text(clock, " web01 sshd[", F.col("event_id"), "]: ")
    ip, user = F.col("ip"), text("u", F.col("user_id"))
    return (
        F.when(kind() == "error", text(head, "Failed password for ", user, " from ", ip, " port ", port(), " ssh2"))
        .when(kind() == "signup", text(head, "Failed password for invalid user ", user, " from ", ip, " port ", port(), " ssh2"))
        .when(kind() == "click", text(head, "Accepted password for ", user, " from ", ip, " port ", port(), " ssh2"))
        .when(kind() == "view", text("  ", head, "Invalid user ", user, " from ", ip, "  "))
        .otherwise(text(clock, " web01 sudo: session opened for user root"))
    )


def access_line() -> Column:
    clock = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    request = text('"GET /p/', F.col("user_id"), "?k=", k(), ' HTTP/1.1" ')
    size = F.when(k() % 10 == 0, "-").otherwise((k() * 10).cast("string"))
    tail = F.when(k() % 3 != 0, text(' "http://ref/', k(), '" "agent ', k() % 7, '"')).otherwise("")
    status = F.when(kind() == "error", "500").otherwise("200")
    line = text(F.col("ip"), " - - [", clock, " +0130] ", request, status, " ", size, tail)
    return F.when(kind() == "purchase", F.replace(line, F.lit("GET"), F.lit("get"))).otherwise(line)


def eve_line() -> Column:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    alert = text(',"alert":{"signature":"sig ', k(), '","signature_id":', F.col("event_id"), ',"category":"c","severity":2}')
    line = text(
        '{"timestamp":"', stamp, '+0000","event_type":"', kind(), '","src_ip":"', F.col("ip"), '","src_port":', port(),
        ',"dest_ip":"192.168.0.1","dest_port":', k(), ',"proto":"TCP"', F.when(kind() == "error", alert).otherwise(""), "}",
    )
    return F.when(kind() == "purchase", F.substr(line, F.lit(1), F.length(line) - 9)).when(
        kind() == "view", F.replace(line, F.lit('"timestamp"'), F.lit('"time"'))
    ).otherwise(line)


def json_line() -> Column:
    """Nested for half of the kinds, with a repeated alias further down."""
    epoch = (F.unix_micros("ts") / 1000000).cast("bigint")
    nested = text(
        '{"time":', epoch, ',"meta":{"z":[1,{"user":"u', F.col("user_id"), '"}],"a":null},"src":{"ip":"', F.col("ip"),
        '"},"destination":{"port":"', k(), '"},"client":"later","event":{"outcome":"denied"}}',
    )
    flat = text(
        '{"ts":"', F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), '","Client-IP":" ', F.col("ip"), ' ","proto":"TCP","status":', k() + 400,
        ',"url":"/x/', k(), '","account":"","uid":"u', F.col("user_id"), '"}',
    )
    return F.when(kind().isin("error", "signup"), nested).otherwise(flat)


def logfmt_line() -> Column:
    return text(
        "ts=", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "Z level=info src=", F.col("ip"), ' msg="said ', k(),
        ' and left" dport=', k(), " user=x user=u", F.col("user_id"), F.when(kind() == "error", " result=failed").otherwise(""),
    )


def plain_line() -> Column:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        F.when(kind() == "error", text(stamp, " gate: ssh login rejected, from ", F.col("ip"), " by way of ", port()))
        .when(kind() == "click", text(F.col("ip"), ' "GET /q/', k(), ' HTTP/1.1" 403 [', F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), " +0000]"))
        .when(kind() == "view", text(F.date_format("ts", "MMM d HH:mm:ss"), " udp flow ", F.col("ip"), " 192.168.0.", k(), " 999.1.1.1"))
        .when(kind() == "signup", text("dropped: from ", F.col("ip"), " bound to 10.9.8.", k()))
        .otherwise(text("opaque message ", F.col("event_id")))
    )


def lines(spark, sf_dir: str, line: Column) -> DataFrame:
    made = spread(base(spark, sf_dir)).withColumn("text", line).drop("ts", "ip")
    return to_lines(made, "text")


def events(parsed: DataFrame, *raw: str) -> DataFrame:
    chosen = [F.col(f"raw.{name}").alias(name.replace(".", "_")) for name in raw]
    return parsed.where(accepted()).select("event_id", micros("ts"), "source_ip", "dest_ip", "protocol", *chosen)


@query(
    "parse_auth",
    f"""WITH {BASE} SELECT event_id, {SECOND_SQL} AS ts_us, ip AS source_ip, CAST(NULL AS VARCHAR) AS dest_ip,
    'ssh' AS protocol, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'accepted' ELSE 'invalid_user' END
      AS outcome, 'u' || CAST(user_id AS VARCHAR) AS username,
    CASE WHEN event_type <> 'view' THEN k + 40000 END AS source_port,
    CASE WHEN event_type <> 'view' THEN 'sshd' END AS service
    FROM base WHERE event_type <> 'purchase' AND event_id % 50 <> 1""",
)
def parse_auth_lines(spark, sf_dir):
    parsed = parse_lines(lines(spark, sf_dir, auth_line()), "auth_log", OPTIONS)
    return events(parsed, "outcome", "username", "source_port", "service")


@query(
    "parse_access",
    f"""WITH {BASE} SELECT event_id, epoch_us(date_trunc('second', ts) - INTERVAL 90 MINUTE) AS ts_us, ip AS source_ip,
    CAST(NULL AS VARCHAR) AS dest_ip, 'http' AS protocol, 'GET' AS method,
    '/p/' || CAST(user_id AS VARCHAR) || '?k=' || CAST(k AS VARCHAR) AS path, 'HTTP/1.1' AS http_version,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
    CASE WHEN k % 10 <> 0 THEN CAST(k * 10 AS BIGINT) END AS size,
    CASE WHEN k % 3 <> 0 THEN 'http://ref/' || CAST(k AS VARCHAR) END AS referer,
    CASE WHEN k % 3 <> 0 THEN 'agent ' || CAST(k % 7 AS VARCHAR) END AS user_agent
    FROM base WHERE event_type <> 'purchase'""",
)
def parse_access_lines(spark, sf_dir):
    parsed = parse_lines(lines(spark, sf_dir, access_line()), "nginx", OPTIONS)
    return events(parsed, "method", "path", "http_version", "status", "size", "referer", "user_agent")


@query(
    "parse_eve",
    f"""WITH {BASE} SELECT event_id, epoch_us(ts) AS ts_us, ip AS source_ip, '192.168.0.1' AS dest_ip, 'tcp' AS protocol,
    event_type, k + 40000 AS src_port, k AS dest_port,
    CASE WHEN event_type = 'error' THEN 'sig ' || CAST(k AS VARCHAR) END AS alert_signature,
    CASE WHEN event_type = 'error' THEN event_id END AS alert_signature_id,
    CASE WHEN event_type = 'error' THEN 2 END AS alert_severity
    FROM base WHERE event_type NOT IN ('purchase', 'view')""",
)
def parse_eve_lines(spark, sf_dir):
    parsed = parse_lines(lines(spark, sf_dir, eve_line()), "suricata", OPTIONS)
    return events(
        parsed.withColumnRenamed("event_type", "made_type"),
        "event_type", "src_port", "dest_port", "alert.signature", "alert.signature_id", "alert.severity",
    )


@query(
    "parse_json",
    f"""WITH {BASE}, kinds AS (SELECT *, event_type IN ('error', 'signup') AS nested FROM base)
    SELECT event_id, {SECOND_SQL} AS ts_us, ip AS source_ip,
    CAST(NULL AS VARCHAR) AS dest_ip, CASE WHEN NOT nested THEN 'tcp' END AS protocol,
    CASE WHEN nested THEN 'denied' END AS outcome, CASE WHEN nested THEN k END AS dest_port,
    CASE WHEN NOT nested THEN '/x/' || CAST(k AS VARCHAR) END AS path, CASE WHEN NOT nested THEN k + 400 END AS status,
    'u' || CAST(user_id AS VARCHAR) AS username, CAST(NULL AS VARCHAR) AS message,
    CASE WHEN nested THEN 8 ELSE 7 END AS fields
    FROM kinds""",
)
def parse_json_lines(spark, sf_dir):
    parsed = parse_lines(lines(spark, sf_dir, json_line()), "custom", OPTIONS)
    return events(parsed, "outcome", "dest_port", "path", "status", "username", "message", "fields").withColumn(
        "fields", F.size("fields")
    )


@query(
    "parse_logfmt",
    f"""WITH {BASE} SELECT event_id, {SECOND_SQL} AS ts_us, ip AS source_ip,
    CAST(NULL AS VARCHAR) AS dest_ip, CAST(NULL AS VARCHAR) AS protocol,
    CASE WHEN event_type = 'error' THEN 'failed' END AS outcome, k AS dest_port, 'u' || CAST(user_id AS VARCHAR) AS username,
    'said ' || CAST(k AS VARCHAR) || ' and left' AS msg, CASE WHEN event_type = 'error' THEN 7 ELSE 6 END AS fields
    FROM base""",
)
def parse_logfmt_lines(spark, sf_dir):
    parsed = parse_lines(lines(spark, sf_dir, logfmt_line()), "custom", OPTIONS)
    found = events(parsed, "outcome", "dest_port", "username", "fields")
    return found.withColumn("msg", F.try_variant_get(F.col("fields")["msg"], "$", "string")).withColumn(
        "fields", F.size("fields")
    )


_STAMP = "epoch_us(TIMESTAMP '2024-02-01 00:00:00')"


@query(
    "parse_plain_text",
    f"""WITH {BASE} SELECT event_id,
    CASE WHEN event_type IN ('error', 'click', 'view') THEN {SECOND_SQL} ELSE {_STAMP} END AS ts_us,
    CASE WHEN event_type <> 'purchase' THEN ip END AS source_ip,
    CASE event_type WHEN 'view' THEN '192.168.0.' || CAST(k AS VARCHAR) WHEN 'signup' THEN '10.9.8.' || CAST(k AS VARCHAR) END
      AS dest_ip,
    CASE event_type WHEN 'error' THEN 'ssh' WHEN 'click' THEN 'http' WHEN 'view' THEN 'udp' END AS protocol,
    CASE WHEN event_type = 'error' THEN 'failed' END AS outcome,
    CASE WHEN event_type = 'click' THEN 'GET' END AS method,
    CASE WHEN event_type = 'click' THEN '/q/' || CAST(k AS VARCHAR) END AS path,
    CASE WHEN event_type = 'click' THEN 403 END AS status
    FROM base""",
)
def parse_plain_lines(spark, sf_dir):
    parsed = parse_lines(lines(spark, sf_dir, plain_line()), "custom", OPTIONS)
    return events(parsed, "outcome", "method", "path", "status")


@query(
    "ingest_stats",
    f"""WITH {BASE} SELECT count(*) AS received,
    count(*) FILTER (WHERE event_type <> 'purchase' AND event_id % 50 <> 1) AS parsed,
    count(*) FILTER (WHERE event_type = 'purchase') AS unrecognized,
    count(*) FILTER (WHERE event_type <> 'purchase' AND event_id % 50 = 1) AS rejected FROM base""",
)
def ingest_statistics(spark, sf_dir):
    blank = F.when(F.col("event_id") % 9 == 0, "\n \t \n").otherwise("")
    parsed = parse_lines(lines(spark, sf_dir, F.concat(auth_line(), blank)), "auth_log", OPTIONS)
    return parsed.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(accepted()).alias("parsed"),
        F.count_if(F.col("recognized").isNull()).alias("unrecognized"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
    )


@query(
    "parse_mixed_formats",
    f"""WITH {BASE} SELECT event_id, ip AS source_ip,
    CASE event_type WHEN 'error' THEN 'ssh' WHEN 'click' THEN 'http' WHEN 'signup' THEN 'tcp' END AS protocol,
    CASE WHEN event_type = 'click' THEN epoch_us(date_trunc('second', ts) - INTERVAL 90 MINUTE)
         WHEN event_type = 'signup' THEN epoch_us(ts) ELSE {SECOND_SQL} END AS ts_us,
    CASE WHEN event_type = 'click' THEN CAST(NULL AS INTEGER) WHEN event_type <> 'error' THEN k END AS dest_port
    FROM base WHERE event_type <> 'purchase' AND (event_type <> 'error' OR event_id % 50 <> 1)""",
)
def parse_mixed_formats(spark, sf_dir):
    """Four formats in one input, parsed in one pass."""
    line = (
        F.when(kind() == "error", auth_line()).when(kind() == "click", access_line()).when(kind() == "signup", eve_line())
        .when(kind() == "view", logfmt_line()).otherwise(eve_line())
    )
    source = (
        F.when(kind() == "error", "auth_log").when(kind() == "click", "apache").when(kind() == "view", "custom").otherwise("suricata")
    )
    mixed = lines(spark, sf_dir, line).withColumn("source_type", source)
    return events(parse_mixed(mixed, OPTIONS), "dest_port").drop("dest_ip")


@query(
    "sniff_formats",
    f"""WITH {BASE}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM base),
    told AS (SELECT *, CASE WHEN user_id % 4 = 3 AND place <= 30 THEN NULL
        WHEN user_id % 4 = 0 AND event_type <> 'purchase' THEN 'auth_log'
        WHEN user_id % 4 = 1 AND event_type <> 'purchase' THEN 'nginx'
        WHEN user_id % 4 = 2 AND event_type <> 'purchase' THEN 'suricata'
        WHEN user_id % 4 = 3 THEN 'auth_log' END AS format FROM placed)
    SELECT user_id, arg_min(format, place) FILTER (WHERE format IS NOT NULL AND place <= 25) AS source_type
    FROM told GROUP BY user_id""",
)
def sniff_formats(spark, sf_dir):
    """A log per user; a quarter of them only tell their format after line 30."""
    user = F.col("user_id")
    line = F.when(user % 4 == 0, auth_line()).when(user % 4 == 1, access_line()).when(user % 4 == 2, eve_line())
    made = base(spark, sf_dir)
    earlier = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    late = F.when(earlier <= 30, text("note ", F.col("event_id"))).otherwise(
        text("Jan 1 00:00:00 web01 sshd[1]: Invalid user x from ", F.col("ip"))
    )
    logs = to_lines(made.withColumn("text", F.coalesce(line, late)).select("user_id", "event_id", "text"), "text")
    return sniff_groups(logs, "user_id", "event_id")


_W = r"[\pL\pN\pM_]"
_NOT = r"(?:^|[^\pL\pN\pM_])"
_END = r"(?:[^\pL\pN\pM_]|$)"
_IP4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"


@query(
    "freetext_entities",
    rf"""WITH split_lines AS (
      SELECT doc_id, unnest(regexp_split_to_array(text, '[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS raw_line
      FROM documents),
    clean AS (SELECT doc_id, regexp_replace(raw_line, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') AS line FROM split_lines),
    found AS (
      SELECT doc_id, line, lower(line) AS low,
        nullif(regexp_extract(line, '(?i){_NOT}from\s+({_IP4}){_END}', 1), '') AS from_ip,
        nullif(regexp_extract(line, '(?i){_NOT}to\s+({_IP4}){_END}', 1), '') AS to_ip,
        list_filter(regexp_extract_all(line, '{_NOT}({_IP4})', 1), lambda x: list_bool_and(
          list_transform(string_split(x, '.'), lambda p: CAST(p AS INTEGER) <= 255))) AS ips,
        regexp_matches(line, '"[A-Z]+\s+\S+\s+HTTP/[0-9.]+"') AS request,
        len(regexp_extract_all(line, '[A-Za-z_][\pL\pN\pM_.\-]*=(?:"(?:[^"\\]|\\.)*"|\S+)')) AS pairs
      FROM clean WHERE line <> ''),
    entities AS (SELECT doc_id, pairs >= 2 OR (starts_with(line, '{{') AND json_valid(line)) AS structured,
      coalesce(from_ip, ips[1]) AS source_ip,
      coalesce(to_ip, CASE WHEN from_ip IS NULL THEN ips[2] END) AS dest_ip,
      CASE WHEN request THEN 'http' WHEN regexp_matches(low, '{_NOT}http') THEN 'http'
           WHEN regexp_matches(low, '{_NOT}ssh') THEN 'ssh' WHEN regexp_matches(low, '{_NOT}tcp') THEN 'tcp'
           WHEN regexp_matches(low, '{_NOT}udp') THEN 'udp' WHEN regexp_matches(low, '{_NOT}dns') THEN 'dns'
           WHEN regexp_matches(low, '{_NOT}ftp') THEN 'ftp' WHEN regexp_matches(low, '{_NOT}smtp') THEN 'smtp' END AS protocol,
      CASE WHEN regexp_matches(line, '(?i){_NOT}(?:fail|failed|failure|invalid|denied|deny|unauthor{_W}*|reject{_W}*|error){_END}')
           THEN 'failed' END AS outcome,
      CAST(length(line) AS INTEGER) AS length
    FROM found)
    SELECT doc_id, structured, CASE WHEN NOT structured THEN source_ip END AS source_ip,
      CASE WHEN NOT structured THEN dest_ip END AS dest_ip, CASE WHEN NOT structured THEN protocol END AS protocol,
      CASE WHEN NOT structured THEN outcome END AS outcome, CASE WHEN NOT structured THEN length END AS length
    FROM entities""",
)
def freetext_entities(spark, sf_dir):
    """Every line of the documents' text, and the entities of those that carry no fields."""
    parsed = parse_lines(
        to_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text"), "custom", OPTIONS
    )
    structured = F.col("raw.message").isNull()
    entities = {
        "source_ip": F.col("source_ip"),
        "dest_ip": F.col("dest_ip"),
        "protocol": F.col("protocol"),
        "outcome": F.col("raw.outcome"),
        "length": F.length("raw.message"),
    }
    return parsed.select(
        "doc_id", structured.alias("structured"), *[F.when(~structured, c).alias(k) for k, c in entities.items()]
    )
