"""Log lines: envelope, record, field edge cases, rejects."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from leakguard.functions.fields import epoch_time, seconds_to_us, syslog_body
from leakguard.sources import landing
from leakguard.sources import lines as src
from leakguard.sources.inventory import routes_frame, scan_inventory

RECORD = {
    "time": "1734345934.123", "client": "192.0.2.7", "server": "203.0.113.1", "method": "GET",
    "url": "/en/25", "status": 200, "sent": 123, "duration": "0.123", "host": "h", "agent": "a",
}


def record(**changes):
    r = {**RECORD, **changes}
    return json.dumps({k: v for k, v in r.items() if v is not None})


@pytest.mark.parametrize(
    "text,us",
    [
        ("1734345934.123", 1734345934123000), ("1734345934", 1734345934000000), ("0.000", 0),
        ("12", 12000000), ("-0.5", -500000), ("1.123456789", 1123456), ("1.1234567890", None),
        (".5", None), ("1.", None), ("", None), ("abc", None), ("1e3", None), (None, None),
        ("1.2.3", None), (" 1", None), ("9000000000000", 9000000000000000000),
        ("9" * 40, None), ("9300000000000", None),
    ],
)
def test_seconds(spark, text, us):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(
        seconds_to_us(F.col("t")).alias("us"), F.unix_micros(epoch_time(F.col("t"))).alias("at")
    ).first()
    assert (row.us, row.at) == (us, us)


@pytest.mark.parametrize(
    "line,body",
    [
        ("<134>Jan  1 00:00:00 edge nginx: {x}", "{x}"),
        ("<134>Oct 11 22:14:15 edge nginx[12]: {x: 1}", "{x: 1}"),
        ("<134>1 2024-01-01T00:00:00Z edge nginx - - - {x}", "{x}"),
        ('<134>1 2024-01-01T00:00:00Z edge nginx 7 id [a b="c\\]d"][e f="g"] {x}', "{x}"),
        ("61 <134>1 2024-01-01T00:00:00Z edge nginx - - - {x}", "{x}"),
        ("{x}", None), ("", None), ("<134>garbage", None),
        ("<134>1 2024-01-01T00:00:00Z edge nginx - - -", None),
    ],
)
def test_syslog(spark, line, body):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(syslog_body(F.col("line"))).first()[0] == body


CASES = [
    (record(), None), (record(client="2001:db8::1"), None), (record(duration="x"), None),
    (record(status=None, sent=None, agent=None), None), (record(extra=1), None),
    ("not json", "json"), ("", "json"), ("[]", "json"), ("{}", "client"),
    (record()[:-1], "json"), (record(status="abc"), "json"), (record() + " tail", "json"),
    (record() + record(), "json"), (record() + " }", "json"), (record() + " junk}", "json"),
    (record() + "] junk}", "json"), (record() + "," + record(), "json"), (f"  {record()} ", None),
    (record(client="999.1.1.1"), "client"), (record(client=""), "client"),
    (record(client=None), "client"), (record(server="unix:"), "server"),
    (record(time="abc"), "time"), (record(time=None), "time"), (record(time="1."), "time"),
    # any text inside a value
    (record(url="/x?leakguard_end"), None), (record(agent='}{"\\ ][ }\n'), None), (record(url="\\"), None),
    (record(agent='a","b":"' + "\\" * 3), None), (record(agent="{" * 5_000 + '"' * 5_000), None),
    # nested values of other fields
    (record(extra={"a": [1, {"b": "}"}], "c": {}}), None), (record(extra=[]) + "]", "json"),
    (record(extra={}) + "{}", "json"), (record(extra=[[]]) + " x", "json"), (record(extra={"a": 1}) + "}", "json"),
    ("[" + record() + "]", "json"), ('"' + "x" * 40 + '"', "json"), (record(extra=[1])[:-1] + "]", "json"),
    ("x" + record(), "json"), ("\u00a0" + record(), "json"), (record(server="\u2028").replace("\\u2028", "::1"), None),
]


def test_records(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    lines = spark.createDataFrame(rows, "seq long, line string")
    requests, rejects = src.parse_lines(lines, envelope="none")
    bad = {r.seq: r.reject_reason for r in rejects.collect()}
    good = {r.seq: r for r in requests.collect()}
    assert {i: reason for i, (_, reason) in enumerate(CASES) if reason} == bad
    assert set(good) == {i for i, (_, reason) in enumerate(CASES) if not reason}
    assert good[0].duration_us == 123000 and good[2].duration_us is None
    assert good[0].client_key.hex() == "00000000000000000000ffffc0000207"
    assert (good[0].family, good[1].family) == (4, 6)
    assert (good[3].status, good[3].sent, good[3].agent) == (0, 0, None)
    utc = good[0].time.astimezone(timezone.utc).replace(tzinfo=None)
    assert utc == datetime(2024, 12, 16, 10, 45, 34, 123000)


def test_lines_without_seq_are_rejected(spark):
    lines = spark.createDataFrame([(None, record()), (4, record())], "seq long, line string")
    requests, rejects = src.parse_lines(lines, envelope="none")
    assert [r.seq for r in requests.collect()] == [4]
    assert [(r.seq, r.reject_reason) for r in rejects.collect()] == [(None, "seq")]


def test_reject_head_and_quarantine(spark, tmp_path):
    lines = spark.createDataFrame(
        [(1, "no header"), (2, "<134>Jan  1 00:00:00 e n: not json at all")], "seq long, line string"
    )
    _, rejects = src.parse_lines(lines)
    got = {r.seq: (r.reject_reason, r.head) for r in rejects.collect()}
    assert got == {1: ("unpack", "no header"), 2: ("json", "not json a")}
    src.write_rejected(rejects, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).filter("reject_reason = 'json'").count() == 1


def test_readers(spark, tmp_path):
    lines = spark.createDataFrame([(7, "a\tb"), (9, "c")], "seq long, line string")
    want = [(7, "a\tb"), (9, "c")]
    lines.select(F.concat_ws("\t", "seq", "line")).write.text(str(tmp_path / "text"))
    lines.write.parquet(str(tmp_path / "parquet"))
    lines.write.json(str(tmp_path / "json"))
    for format in ("text", "parquet", "json"):
        got = src.read_log_lines(spark, str(tmp_path / format), format=format)
        assert sorted(map(tuple, got.collect())) == want, format


def test_parser_registry(spark):
    @src.parser("everything-bad")
    def bad(lines, body):
        return lines.withColumn("reject_reason", F.lit("json"))

    lines = spark.createDataFrame([(1, "x")], "seq long, line string")
    out = src.decode_lines(lines, "everything-bad", "none")
    assert src.rejected(out).count() == 1
    with pytest.raises(ValueError):
        src.decode_lines(lines, envelope="other")


def test_scan_inventory(spark, tmp_path):
    (tmp_path / "en" / "deep").mkdir(parents=True)
    (tmp_path / "en" / "a.bin").write_bytes(b"12345")
    (tmp_path / "en" / "deep" / "b.bin").write_bytes(b"")
    (tmp_path / "void").mkdir()
    df = scan_inventory(spark, [f"{tmp_path}/"], "2024-01-01")
    got = {r.path: (r.size, r.is_dir) for r in df.collect()}
    root = str(tmp_path)
    assert got == {
        f"{root}/en/a.bin": (5, False), f"{root}/en/deep/b.bin": (0, False),
        root: (None, True), f"{root}/en": (None, True), f"{root}/en/deep": (None, True),
        f"{root}/void": (None, True),
    }
    assert routes_frame(spark, {"en": "/data/en/"}).first().root == "/data/en/"


def test_landed_lines_are_numbered_in_order(spark, tmp_path):
    """Several files, several splits a file: dense numbers in the order of files and lines."""
    raw, target = tmp_path / "raw", str(tmp_path / "landed")
    raw.mkdir()
    want = []
    for name in ("b.log", "a.log", "c.log", "empty.log"):
        lines = [f"{name} line {i} {'x' * (i % 50)}" for i in range(0 if name == "empty.log" else 400)]
        (raw / name).write_text("".join(line + "\n" for line in lines))
    for name in ("a.log", "b.log", "c.log"):
        want += (raw / name).read_text().splitlines()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        landing.land_lines(spark, str(raw), target)
        assert len({r.block for r in landing.raw_lines(spark, str(raw)).select("block").distinct().collect()}) > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = src.read_log_lines(spark, target, format="parquet").orderBy("seq").collect()
    assert [(r.seq, r.line) for r in got] == list(enumerate(want))
    # later files go on from there; the oldest first
    more = tmp_path / "more"
    more.mkdir()
    for at, name in enumerate(("z.log", "y.log")):
        (more / name).write_text(f"{name}\n")
        os.utime(more / name, (1_700_000_000 + at, 1_700_000_000 + at))
    landing.land_lines(spark, str(more), target, order="time", start=landing.next_seq(spark, target))
    got = src.read_log_lines(spark, target, format="parquet").filter("seq >= 1200").orderBy("seq").collect()
    assert [(r.seq, r.line) for r in got] == [(1200, "z.log"), (1201, "y.log")]


def test_raw_syslog_files_become_requests(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    text = "".join(f"<134>Jan  1 00:00:00 edge nginx: {record(url=f'/en/{i}')}\n" for i in range(20))
    (tmp_path / "raw" / "access.log").write_text(text)
    landing.land_lines(spark, str(tmp_path / "raw"), str(tmp_path / "landed"))
    requests, rejects = src.parse_lines(src.read_log_lines(spark, str(tmp_path / "landed"), format="parquet"))
    assert [(r.seq, r.url) for r in requests.orderBy("seq").collect()] == [(i, f"/en/{i}") for i in range(20)]
    assert rejects.count() == 0


def test_topic_partitions_share_no_number(spark):
    rows = [(p, o, bytearray(f"{p}/{o}".encode())) for p in (0, 1, 300) for o in (0, 1, 1 << 39)]
    got = landing.kafka_lines(spark.createDataFrame(rows, "partition int, offset long, value binary")).collect()
    assert len({r.seq for r in got}) == len(rows)
    by_seq = [r.line for r in sorted(got, key=lambda r: r.seq)]
    assert by_seq == [f"{p}/{o}" for p, o, _ in rows]
