"""Log lines made from ``events``, and the SQL view of the same facts.

Every row of ``events`` becomes one line; line_id is the event id. The SQL twins never see the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.runtime import settle

from .registry import table

# The same columns as in events_frame(), for the SQL twins.
EV = """ev AS (
  SELECT event_id, ts, user_id, event_type,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip,
         CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 302 WHEN 'signup' THEN 404
                         WHEN 'purchase' THEN 201 ELSE 500 END AS status,
         CAST(round(value * 100) AS BIGINT) AS size,
         event_type || ' by user ' || user_id || ' cost ' || CAST(round(value * 100) AS BIGINT) AS msg,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
         'app-' || (event_id % 4) AS source_path,
         date_trunc('second', ts) AS sec,
         date_trunc('millisecond', ts) AS ms
  FROM events)"""

# Lines of the mixed-quality access log: some blank, some that no format knows.
LOG = (
    EV
    + """, log AS (
  SELECT *, CASE WHEN event_id % 97 = 0 THEN 'blank' WHEN event_id % 89 = 0 THEN 'failed' ELSE 'parsed' END AS outcome,
         'GET /' || event_type || '/' || user_id AS request
  FROM ev)"""
)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input of fewer splits than cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def events_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"))
    kind, user = F.col("event_type"), F.col("user_id")
    status = (
        F.when(kind == "view", 200)
        .when(kind == "click", 302)
        .when(kind == "signup", 404)
        .when(kind == "purchase", 201)
        .otherwise(500)
    )
    size = F.round(F.col("value") * 100).cast("bigint")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.concat(
            F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), F.pmod(user, F.lit(256)).cast("string")
        ).alias("ip"),
        status.alias("status"),
        size.alias("size"),
        F.concat(kind, F.lit(" by user "), user.cast("string"), F.lit(" cost "), size.cast("string")).alias("msg"),
        F.concat(F.lit("app-"), F.pmod("event_id", F.lit(4)).cast("string")).alias("source_path"),
    )


def stamp(pattern: str, ts: Column | str = "ts") -> Column:
    return F.date_format(ts, pattern)


def by_type(**words: str) -> Column:
    """A word per event type."""
    chain = F.lit(None).cast("string")
    for kind, word in words.items():
        chain = F.when(F.col("event_type") == kind, word).otherwise(chain)
    return chain


def _odd(a: Column, b: Column) -> Column:
    """``a`` for odd events, ``b`` for even ones."""
    return F.when(F.pmod("event_id", F.lit(2)) == 1, a).otherwise(b)


_ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_ISO_NS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'"
_CLF = "dd/MMM/yyyy:HH:mm:ss"


def raw_line(fmt: str) -> Column:
    """The text of one event in a format."""
    e, msg, ip = F.col("event_type"), F.col("msg"), F.col("ip")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    if fmt == "aws_cloudwatch":
        batch = F.struct(
            F.concat(F.lit("/svc/"), e).alias("logGroup"),
            F.lit("s1").alias("logStream"),
            F.array(
                F.struct(millis.alias("timestamp"), F.concat(F.lit("  "), msg, F.lit(" ")).alias("message")),
                F.struct((millis + 1).alias("timestamp"), F.lit("fatal second event").alias("message")),
            ).alias("logEvents"),
        )
        word = by_type(error="[ERROR] ", signup="[WARN] ", view="", click="", purchase="[info] ")
        return _odd(F.concat(stamp(_ISO_MS), F.lit(" "), word, msg), F.to_json(batch))
    if fmt == "gcp_logging":
        severity = by_type(view="INFO", click="NOTICE", signup="warning", purchase="custom", error="EMERGENCY")
        common = [
            stamp(_ISO_NS).alias("timestamp"),
            severity.alias("severity"),
            F.struct(F.lit("vm").alias("type"), F.struct(ip.alias("instance_id")).alias("labels")).alias("resource"),
        ]
        return _odd(
            F.to_json(F.struct(*common, F.concat(F.lit(" "), msg).alias("textPayload"))),
            F.to_json(F.struct(*common, F.struct(msg.alias("message")).alias("jsonPayload"))),
        )
    if fmt == "azure_monitor":
        word = by_type(view="Information", click="Verbose", signup="Warn", purchase="odd", error="Fatal")
        number = F.pmod("event_id", F.lit(7))
        app = F.to_json(
            F.struct(stamp(_ISO_MS).alias("time"), word.alias("level"), F.lit("app").alias("category"), msg.alias("message"))
        )
        agent = F.to_json(
            F.struct(
                stamp(_ISO_MS).alias("TimeGenerated"), ip.alias("Computer"), number.alias("SeverityLevel"), msg.alias("Message")
            )
        )
        line = _odd(app, agent)
        return F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("["), line, F.lit(",{}]"))).otherwise(line)
    if fmt in ("docker_json", "kubernetes", "containerd"):
        stream = F.when(e.isin("error", "signup"), "stderr").otherwise("stdout")
        docker = F.to_json(
            F.struct(F.concat(msg, F.lit("\n")).alias("log"), stream.alias("stream"), stamp(_ISO_NS).alias("time"))
        )
        flag = F.when(F.pmod("event_id", F.lit(5)) == 0, "P").otherwise("F")
        cri = F.concat_ws(" ", stamp(_ISO_NS), stream, flag)
        if fmt == "docker_json":
            return docker
        if fmt == "kubernetes":
            return F.when(F.pmod("event_id", F.lit(3)) == 0, docker).otherwise(F.concat_ws(" ", cri, msg))
        word = by_type(view="info", click="debug", signup="warn", purchase="odd", error="critical")
        body = F.to_json(F.struct(word.alias("level"), msg.alias("msg"), e.alias("component")))
        return F.concat_ws(" ", cri, _odd(body, F.concat(F.lit("plugin/x "), msg)))
    request = F.concat(F.lit("GET /"), e, F.lit("/"), F.col("user_id").cast("string"))
    if fmt in ("apache_access", "nginx_access", "nginx"):
        zone = F.when(F.pmod("user_id", F.lit(2)) == 1, "+0230").otherwise("+0000")
        client = F.when(F.pmod("event_id", F.lit(10)) == 0, F.lit("fe80::1")).otherwise(ip) if fmt == "nginx_access" else ip
        tail = {"apache_access": "", "nginx_access": ' "10.9.9.9"', "nginx": " 0.005 up"}[fmt]
        return F.concat(
            F.format_string(
                '%s - u%d [%s %s] "%s" %d %d "-" "client/1.0"',
                client,
                F.col("user_id"),
                stamp(_CLF),
                zone,
                request,
                F.col("status"),
                F.col("size"),
            ),
            F.lit(tail),
        )
    if fmt == "apache_error":
        word = by_type(view="notice", click="debug", signup="warn", purchase="trace1", error="crit")
        modern = F.format_string("[Mon Jan 01 00:00:00 2024] [core:%s] [pid 12] [client %s:80] %s", word, ip, msg)
        return _odd(modern, F.format_string("[Mon Jan 01 00:00:00 2024] [%s] %s", word, msg))
    if fmt == "json":
        word = by_type(view="info", click="trace", signup="warn", error="err")
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        number = F.concat(
            F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")
        )
        text = F.to_json(
            F.struct(
                stamp("yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
                word.alias("severity"),
                msg.alias("msg"),
                ip.alias("host"),
                F.col("status").alias("status"),
            )
        )
        plain = F.concat(F.lit('{"ts":'), number, F.lit(',"lvl":"FATAL","text":"'), msg, F.lit('","server":"'), ip, F.lit('"}'))
        return _odd(text, plain)
    if fmt == "syslog":
        priority = by_type(view="14", click="15", signup="12", purchase="13", error="8")
        kind = F.pmod("event_id", F.lit(3))
        new = F.format_string("<%s>1 %s host%d app - ID1 [a b=\"c\"] %s", priority, stamp(_ISO_MS), F.col("user_id"), msg)
        old = F.format_string("<%s>%s host%d su[12]: %s", priority, stamp("MMM dd HH:mm:ss"), F.col("user_id"), msg)
        bsd = F.format_string("%s host%d sshd: %s", stamp("MMM dd HH:mm:ss"), F.col("user_id"), msg)
        return F.when(kind == 0, new).when(kind == 1, old).otherwise(bsd)
    if fmt == "android":
        letter = by_type(view="V", click="I", signup="W", purchase="F", error="E")
        return F.format_string("%s  1702  2395 %s Tag%d: %s", stamp("MM-dd HH:mm:ss.SSS"), letter, F.col("user_id"), msg)
    if fmt == "java_log":
        word = by_type(view="INFO", click="TRACE", signup="WARN", purchase="FATAL", error="ERROR")
        full = F.format_string("%s %s [main] org.app.C%d: %s", stamp("yyyy-MM-dd HH:mm:ss,SSS"), word, F.col("user_id"), msg)
        return _odd(full, F.format_string("%s %s org.app.C%d: %s", stamp("yy/MM/dd HH:mm:ss"), word, F.col("user_id"), msg))
    if fmt == "hdfs":
        word = by_type(view="INFO", click="DEBUG", signup="WARN", purchase="FATAL", error="ERROR")
        return F.format_string("%s 148 %s dfs.Node%d: %s", stamp("yyMMdd HHmmss"), word, F.col("user_id"), msg)
    if fmt == "supercomputer":
        word = by_type(view="INFO", click="debug", signup="WARNING", purchase="SEVERE", error="ERROR")
        head = F.format_string("- 1117838570 %s R%d", stamp("yyyy.MM.dd"), F.col("user_id"))
        bgl = F.format_string("%s %s R01 RAS KERNEL %s %s", head, stamp("yyyy-MM-dd-HH.mm.ss"), word, msg)
        return _odd(bgl, F.concat_ws(" ", head, e, F.lit("short")))
    if fmt == "windows":
        word = by_type(view="Info", click="Debug", signup="Warn", purchase="warning", error="Error")
        return F.format_string("%s, %s CBS %s", stamp("yyyy-MM-dd HH:mm:ss"), word, msg)
    if fmt == "proxifier":
        verb = by_type(view="open", click="close", signup="failed", purchase="open", error="error")
        return F.format_string("[%s] app%d.exe *64 - %s %s", stamp("MM.dd HH:mm:ss"), F.col("user_id"), verb, ip)
    if fmt == "hpc":
        event = by_type(view="boot", click="boot", signup="state.warning", purchase="state.unavailable", error="error")
        return F.format_string("%d node-%d unix.hw %s 1077804742 1 %s", F.col("event_id"), F.col("user_id"), event, msg)
    if fmt == "healthapp":
        return F.format_string("%s|Step_%d|30002312|%s", stamp("yyyyMMdd-H:m:s:SSS"), F.col("user_id"), msg)
    if fmt == "openstack":
        word = by_type(view="info", click="TRACE", signup="WARNING", purchase="AUDIT", error="ERROR")
        return F.format_string(
            "nova-api.log %s 25746 %s nova.c%d [req-1 2 3] %s", stamp("yyyy-MM-dd HH:mm:ss.SSS"), word, F.col("user_id"), msg
        )
    if fmt == "squid":
        epoch = F.format_string("%d.%03d", F.floor(millis / 1000).cast("bigint"), F.pmod(millis, F.lit(1000)))
        result = by_type(view="TCP_HIT", click="TCP_MISS", signup="TCP_DENIED", purchase="TCP_MEM", error="TCP_MISS")
        return F.format_string(
            "%s   %d %s %s/%d %d GET http://x/%s u%d DIRECT/1.2.3.4 -",
            epoch,
            F.col("size"),
            ip,
            result,
            F.col("status"),
            F.col("size"),
            e,
            F.col("user_id"),
        )
    if fmt == "universal":
        kind = F.pmod("event_id", F.lit(4))
        word = by_type(view="Notice", click="dbg", signup="WARN", purchase="Trace", error="FATAL")
        return (
            F.when(kind == 0, F.concat(stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" - "), word, F.lit(": "), msg))
            .when(kind == 1, F.concat(F.lit("<<"), stamp("MM/dd/yyyy HH:mm:ss"), F.lit(": "), msg))
            .when(kind == 2, msg)
            .otherwise(F.concat(F.lit("run "), F.floor(millis / 1000).cast("string"), F.lit(" "), word, F.lit("|"), msg))
        )
    raise ValueError(fmt)


def rendered(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """LINES of one format, sources app-0 .. app-3."""
    return as_lines(events_frame(spark, sf_dir), raw_line(fmt))


def as_lines(events: DataFrame, raw: Column, source: Column | None = None) -> DataFrame:
    lines = events.select(
        (F.col("source_path") if source is None else source).alias("source_path"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("event_id").alias("line_id"),
        raw.alias("raw"),
    )
    return settle(lines, "raw")


def access_raw() -> Column:
    """An access line per event; every 97th is blank, every 89th is noise."""
    line = F.format_string(
        '%s - - [%s +0000] "GET /%s/%d" %d %d',
        F.col("ip"),
        stamp(_CLF),
        F.col("event_type"),
        F.col("user_id"),
        F.col("status"),
        F.col("size"),
    )
    return (
        F.when(F.pmod("event_id", F.lit(97)) == 0, "   ")
        .when(F.pmod("event_id", F.lit(89)) == 0, F.concat(F.lit("noise "), F.col("event_id").cast("string")))
        .otherwise(line)
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(events_frame(spark, sf_dir), access_raw())


def access_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.operators.entries import parse_entries

    return parse_entries(access_log(spark, sf_dir), fmt="apache_access")


# Four sources in four formats.
MIXED = {"app-0": "apache_access", "app-1": "json", "app-2": "syslog", "app-3": "android"}


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = F.lit(None).cast("string")
    for source, fmt in MIXED.items():
        chain = F.when(F.col("source_path") == source, raw_line(fmt)).otherwise(chain)
    return as_lines(events_frame(spark, sf_dir), chain)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as LINES, one source per document."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    placed = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    return placed.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_path"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("at").cast("bigint").alias("line_id"),
        "raw",
    )
