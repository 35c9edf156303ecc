"""Log-line sources and the line parser.

Readers return one row per line with columns ``seq`` (arrival order) and
``line``; parsers turn such a frame into requests plus rejected lines.  Both are
looked up by name so that a user can add more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakguard.functions.fields import epoch_time, seconds_to_us, syslog_text
from leakguard.functions.net import address_family, address_hex
from leakguard.schemas import LOG_RECORD, REQUEST_COLUMNS
from leakguard.sources.landing import kafka_lines

READERS: dict[str, Callable] = {}
PARSERS: dict[str, Callable] = {}

_LINE_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("line", T.StringType())]
)


def reader(name: str):
    def add(fn: Callable) -> Callable:
        READERS[name] = fn
        return fn

    return add


def parser(name: str):
    def add(fn: Callable) -> Callable:
        PARSERS[name] = fn
        return fn

    return add


def _source(spark: SparkSession, stream: bool, options: dict):
    return (spark.readStream if stream else spark.read).options(**options)


@reader("text")
def read_text(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Text files whose lines start with ``<seq><tab>``.

    Arrival order has to travel with the data: file and split order is not it.
    """
    raw = _source(spark, stream, options).text(path)
    return raw.select(
        F.regexp_extract("value", r"^([0-9]+)\t", 1).try_cast("bigint").alias("seq"),
        F.regexp_replace("value", r"^[0-9]+\t", "").alias("line"),
    )


@reader("parquet")
def read_parquet(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Landed lines as ``seq, line``."""
    return _source(spark, stream, options).schema(_LINE_SCHEMA).parquet(path)


@reader("json")
def read_json(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Landed lines as JSON records ``{"seq": ..., "line": ...}``."""
    return _source(spark, stream, options).schema(_LINE_SCHEMA).json(path)


@reader("kafka")
def read_kafka(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Topic named by ``path``; needs the Kafka connector on the class path.

    Numbered by partition and offset, see ``landing.kafka_lines``.
    """
    raw = (spark.readStream if stream else spark.read).format("kafka")
    return kafka_lines(raw.options(subscribe=path, **options).load())


def read_log_lines(
    spark: SparkSession, path: str, stream: bool = False, format: str = "text", **options
) -> DataFrame:
    return READERS[format](spark, path, stream, **options)


def _computed(frame: DataFrame, **columns) -> DataFrame:
    """Add columns through a generator.

    Unlike a projection it is never copied into the filters and projections
    above it, so an expensive decode runs once per line.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return frame.select("*", F.inline(F.array(made)))


def unpack_syslog(lines: DataFrame) -> DataFrame:
    """Add ``body``: the message without its syslog header, NULL without one."""
    text = _computed(lines, _text=syslog_text(F.col("line")))
    return text.select(*lines.columns, F.nullif("_text", F.lit("")).alias("body"))


# A record without nested values: white space, an object of strings and bare words.  The
# repetitions are possessive, so one pass over the text decides.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_FLAT = rf"(?s)\A[ \t\r\n]*+\{{[^{{}}\[\]\"]*+(?:{_STRING}[^{{}}\[\]\"]*+)*+\}}[ \t\r\n]*+\z"


def _one_object(text: Column) -> Column:
    """Whether ``text`` is one JSON object with nothing but white space around it.

    A reader stops behind the first value and would take text behind it in silence.  A
    record with nested values is scanned by depth: strings are taken out, and of the
    brackets left the first may only close at the very end of the text.
    """
    bare = F.regexp_replace(text, f"(?s){_STRING}", "")
    closed = F.rlike(bare, F.lit(r"(?s)\A[ \t\r\n]*+\{.*\}[ \t\r\n]*+\z"))
    brackets = F.split(F.regexp_replace(bare, r"[^{}\[\]]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends"))
    walked = F.aggregate(
        brackets,
        start,
        lambda s, c: F.struct(
            (s["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            # brackets at which the depth is back at zero; an empty piece is none
            (s["ends"] + F.when((s["depth"] == 1) & c.isin("}", "]"), 1).otherwise(0)).alias("ends"),
        ),
        lambda s: (s["depth"] == 0) & (s["ends"] == 1),
    )
    return F.when(F.rlike(text, F.lit(_FLAT)), True).otherwise(closed & walked)


@parser("nginx")
def parse_nginx(lines: DataFrame, body: str) -> DataFrame:
    """Decode the JSON record in ``body``; add request columns and ``reject_reason``."""
    spec = T.StructType([*LOG_RECORD.fields, T.StructField("_broken", T.StringType())])
    whole = F.when(_one_object(F.col(body)), F.col(body))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    decoded = _computed(lines, _r=F.from_json(whole, spec, options))
    decoded = _computed(
        decoded,
        _client_hex=address_hex("_r.client"),
        _server_hex=address_hex("_r.server"),
        time=epoch_time(F.col("_r.time")),
    )
    # a line without its place in the order could be put before or after any other
    reason = (
        F.when(F.col("seq").isNull() if "seq" in lines.columns else F.lit(False), "seq")
        .when(F.col(body).isNull(), "unpack")
        .when(F.col("_r").isNull() | F.col("_r._broken").isNotNull(), "json")
        .when(F.col("_client_hex").isNull(), "client")
        .when(F.col("_server_hex").isNull(), "server")
        .when(F.col("time").isNull(), "time")
    )
    return decoded.select(
        *lines.columns,
        reason.alias("reject_reason"),
        "time",
        F.unhex("_client_hex").alias("client_key"),
        address_family("_r.client").alias("family"),
        F.coalesce(F.col("_r.status"), F.lit(0)).alias("status"),
        F.coalesce(F.col("_r.sent"), F.lit(0).cast("bigint")).alias("sent"),
        seconds_to_us(F.col("_r.duration")).alias("duration_us"),
        *[f"_r.{name}" for name in ("client", "server", "method", "url", "host", "agent")],
    )


def decode_lines(
    lines: DataFrame, format: str = "nginx", envelope: str = "syslog"
) -> DataFrame:
    """Lines plus request columns and ``reject_reason``, still in one frame.

    ``envelope`` is ``"syslog"`` for wrapped lines or ``"none"`` for bare records.
    """
    if envelope == "syslog":
        lines, body = unpack_syslog(lines), "body"
    elif envelope == "none":
        body = "line"
    else:
        raise ValueError(f"unknown envelope: {envelope}")
    return PARSERS[format](lines, body)


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNull()).select(*REQUEST_COLUMNS)


def rejected(decoded: DataFrame) -> DataFrame:
    """Lines set aside, with the first ten characters of what failed to parse."""
    text = F.coalesce("body", "line") if "body" in decoded.columns else F.col("line")
    return decoded.filter(F.col("reject_reason").isNotNull()).select(
        "seq", "reject_reason", F.substring(text, 1, 10).alias("head"), "line"
    )


def parse_lines(
    lines: DataFrame, format: str = "nginx", envelope: str = "syslog"
) -> tuple[DataFrame, DataFrame]:
    """``(requests, rejected)``."""
    decoded = decode_lines(lines, format, envelope)
    return accepted(decoded), rejected(decoded)


def write_rejected(rejects: DataFrame, path: str) -> None:
    """Quarantine table, one folder per reason."""
    rejects.write.mode("append").partitionBy("reject_reason").parquet(path)
