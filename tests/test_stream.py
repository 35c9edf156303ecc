"""Stream results equal batch results."""

import os
import shutil
import uuid
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from leakguard.operators import buckets, resolve
from leakguard.operators.bans import BanTable
from leakguard.schemas import INVENTORY
from leakguard.sources import fixtures as fx
from leakguard.sources.lines import parse_lines, read_log_lines
from leakguard.streaming.detect import FreshInventory, detect_stream, quarantine_stream, stream_sizes, use_rocksdb


def land(spark, sf_dir, path, files, late=False):
    """Dirty lines as ``files`` text files in arrival order."""
    lines = fx.dirty_lines(spark, sf_dir, late).toPandas().sort_values("seq")
    os.makedirs(path)
    n = -(-len(lines) // files)
    for i in range(files):
        part = lines.iloc[i * n : (i + 1) * n]
        name = os.path.join(path, f"part-{i:03d}.log")
        with open(name, "w") as out:
            for seq, line in zip(part["seq"], part["line"]):
                out.write(f"{seq}\t{line}\n")
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))


def batch_bans(spark, sf_dir, th, late=False):
    requests, _ = parse_lines(fx.dirty_lines(spark, sf_dir, late))
    tracked = resolve.trackable(
        resolve.resolve_sizes(requests, fx.routes(spark, sf_dir), fx.inventory(spark, sf_dir))
    )
    both = buckets.client_bans(requests, th).select("prefix", "blame", "expires_at").unionByName(
        buckets.path_bans(tracked, th).select("prefix", "blame", "expires_at")
    )
    return sorted(map(tuple, both.collect()))


_BATCH = {}


def expected_bans(spark, sf_dir, th):
    if th not in _BATCH:
        _BATCH[th] = batch_bans(spark, sf_dir, th)
    return _BATCH[th]


def run(spark, sf_dir, source, table, checkpoint, th, per_trigger=1, inventory=None):
    lines = read_log_lines(spark, source, stream=True, maxFilesPerTrigger=per_trigger)
    inventory = inventory if inventory is not None else fx.inventory(spark, sf_dir)
    query = detect_stream(
        lines, fx.routes(spark, sf_dir), inventory, th, table, checkpoint,
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    assert query.exception() is None


def stored(table):
    return sorted((r.prefix, r.blame, r.expires_at) for r in table.records().collect())


@pytest.mark.parametrize(
    "files,th",
    [
        (1, fx.PROFILE),
        (3, replace(fx.PROFILE, floor=True)),
        (2, replace(fx.PROFILE, idle_reset_s=4)),
    ],
)
def test_stream_equals_batch(spark, sf_dir, tmp_path, files, th):
    land(spark, sf_dir, str(tmp_path / "in"), files)
    table = BanTable(spark, str(tmp_path / "bans"))
    run(spark, sf_dir, str(tmp_path / "in"), table, str(tmp_path / "ckpt"), th)
    expected = expected_bans(spark, sf_dir, th)
    assert expected
    assert stored(table) == expected
    ids = [r.id for r in table.records().orderBy("id").collect()]
    assert ids == list(range(1, len(expected) + 1))


@pytest.mark.parametrize("files,th", [(20, fx.PROFILE), (3, replace(fx.PROFILE, floor=True))])
def test_late_events_over_many_batches(spark, sf_dir, tmp_path, files, th):
    """Late events come in whole: no watermark, whichever micro-batch they are in."""
    land(spark, sf_dir, str(tmp_path / "in"), files, late=True)
    table = BanTable(spark, str(tmp_path / "bans"))
    run(spark, sf_dir, str(tmp_path / "in"), table, str(tmp_path / "ckpt"), th)
    expected = batch_bans(spark, sf_dir, th, late=True)
    assert stored(table) == expected != expected_bans(spark, sf_dir, th)


def lookups(spark, path, **options):
    return spark.readStream.options(**options).schema(INVENTORY).parquet(path)


def test_streamed_sizes_equal_batch(spark, sf_dir, tmp_path):
    """Lookups come before the requests that need them: the same bans as with a table."""
    land(spark, sf_dir, str(tmp_path / "in"), 3)
    fx.inventory(spark, sf_dir).write.parquet(str(tmp_path / "sizes"))
    table = BanTable(spark, str(tmp_path / "bans"))
    run(spark, sf_dir, str(tmp_path / "in"), table, str(tmp_path / "ckpt"), fx.PROFILE, inventory=lookups(spark, str(tmp_path / "sizes")))
    assert stored(table) == expected_bans(spark, sf_dir, fx.PROFILE)


def sized(spark, tmp_path, batches, ttl_s=100):
    """Sizes that requests see, over micro-batches of (lookups, requests)."""
    out = []
    for name in ("sizes", "asked"):
        os.makedirs(tmp_path / name, exist_ok=True)
    routes = spark.createDataFrame([("en", "/data/en")], "tag string, root string")
    shape = "client_key binary, url string, seq long, family int, time timestamp, sent long"
    asked = spark.readStream.schema(shape).parquet(str(tmp_path / "asked"))
    told = spark.readStream.schema("path string, size long, is_dir boolean, scanned_at timestamp, error boolean")
    frame = stream_sizes(asked, routes, told.parquet(str(tmp_path / "sizes")), ttl_s)
    use_rocksdb(spark)
    for rows, requests in batches:
        other = str(tmp_path / f"o-{uuid.uuid4().hex}")
        given = spark.createDataFrame(rows, "path string, size long, is_dir boolean, at long, error boolean")
        given.selectExpr("path", "size", "is_dir", "timestamp_seconds(at) as scanned_at", "error").coalesce(1).write.parquet(other + "s")
        wanted = spark.createDataFrame(requests, "c int, url string, seq long, at long")
        wanted.selectExpr(
            "cast(concat('k', c) as binary) as client_key", "url", "seq", "4 as family", "timestamp_seconds(at) as time", "1L as sent"
        ).coalesce(1).write.parquet(other + "a")
        for kind, folder in (("s", "sizes"), ("a", "asked")):
            for name in os.listdir(other + kind):
                if name.endswith(".parquet"):
                    os.link(os.path.join(other + kind, name), tmp_path / folder / name)
        query = (
            frame.writeStream.foreachBatch(lambda df, _: out.extend((r.seq, r.found, r.is_dir, r.size) for r in df.collect()))
            .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert query.exception() is None
    return sorted(out)


def test_a_size_lives_with_its_path(spark, tmp_path):
    """Each path's own expiry; new answers replace old ones; errors are no answer."""
    a, b, gone, folder = "/data/en/a", "/data/en/b", "/data/en/gone", "/data/en/dir"
    got = sized(
        spark,
        tmp_path,
        [
            # two clients of a hot path, a path never looked up, one known to be missing
            ([(a, 5, False, 1000, None), (folder, None, True, 1000, None), (gone, None, False, 1000, None)],
             [(1, "/en/a", 1, 1000), (2, "/en/a", 2, 1100), (1, "/en/b", 3, 1000), (1, "/en/gone", 4, 1000), (1, "/en/dir", 5, 1000)]),
            # expired for a, an error does not renew it; b appears
            ([(a, 9, False, 1090, True), (b, 7, False, 1090, False)],
             [(1, "/en/a", 6, 1101), (3, "/en/a", 7, 1100), (1, "/en/b", 8, 1190), (1, "/en/b", 9, 1191)]),
            # a newer answer, an older one late, equal times
            ([(a, 8, False, 1200, None), (a, 6, False, 1150, None), (b, 1, False, 1200, None), (b, 2, False, 1200, None)],
             [(1, "/en/a", 10, 1300), (1, "/en/b", 11, 1200), (1, "/none", 12, 1200)]),
        ],
    )
    no = (False, False, None)
    assert got == [
        (1, True, False, 5), (2, True, False, 5), (3, *no), (4, *no), (5, True, True, None),
        (6, *no), (7, True, False, 5), (8, True, False, 7), (9, *no), (10, True, False, 8), (11, True, False, 2),
    ]


def ban_rows(spark, *seqs, expires="2024-01-01"):
    rows = spark.createDataFrame([(s, 0, f"192.0.{s}.1/24", "b") for s in seqs], "seq long, kind int, prefix string, blame string")
    return rows.withColumn("expires_at", F.lit(expires).cast("timestamp"))


def test_adding_reads_marks_not_records(spark, tmp_path, monkeypatch):
    table = BanTable(spark, str(tmp_path / "bans"))
    table.add(ban_rows(spark, 1, 2), 0)
    monkeypatch.setattr(BanTable, "_records", lambda *_: pytest.fail("records read"))
    table.add(ban_rows(spark, 3).limit(0), 1)
    assert not (tmp_path / "bans/records/version=0/batch=b-1").exists()
    table.add(ban_rows(spark, 4), 2)
    table.add(ban_rows(spark, 1, 2), 0)  # an old batch again
    # a writer that died between its records and its marks: the replay takes the same ids
    shutil.rmtree(tmp_path / "bans/marks/version=0/batch=b-2")
    table._mark("head/version=0", 1, 3)
    table.add(ban_rows(spark, 4), 2)
    # ... and one that died while it replaced the head
    shutil.rmtree(tmp_path / "bans/head/version=0")
    table.add(ban_rows(spark, 5), 3)
    monkeypatch.undo()
    assert sorted((r.id, r.prefix) for r in table.records().collect()) == [(i, f"192.0.{s}.1/24") for i, s in ((1, 1), (2, 2), (3, 4), (4, 5))]


def test_prune_leaves_the_batch_in_flight_to_its_replay(spark, tmp_path):
    table = BanTable(spark, str(tmp_path / "bans"))
    table.add(ban_rows(spark, 1, expires="2023-01-01"), 0)
    table.add(ban_rows(spark, 2, 3), 1)  # written, but its batch was not committed
    table.delete(spark.createDataFrame([(3,)], "id long"))
    table.prune("2023-06-01", in_flight=1)
    assert table.records().count() == 0
    table.add(ban_rows(spark, 2, 3), 1)
    assert sorted((r.id, r.prefix) for r in table.records().collect()) == [(4, "192.0.2.1/24"), (5, "192.0.3.1/24")]
    assert table.remove_old_versions() == 4
    assert not (tmp_path / "bans/records/version=0").exists() and table.records().count() == 2


def test_pruning_while_a_stream_runs(spark, sf_dir, tmp_path):
    """The clock passes a prune interval every batch; ids go on and live bans stay."""
    th = replace(fx.PROFILE, prune_interval_s=60)
    land(spark, sf_dir, str(tmp_path / "in"), 4)
    table = BanTable(spark, str(tmp_path / "bans"))
    now = [datetime(2024, 1, 2, 0, 0, 20, tzinfo=timezone.utc)]

    def clock():
        now[0] += timedelta(seconds=61)
        return now[0]

    lines = read_log_lines(spark, str(tmp_path / "in"), stream=True, maxFilesPerTrigger=1)
    query = detect_stream(
        lines, fx.routes(spark, sf_dir), fx.inventory(spark, sf_dir), th, table, str(tmp_path / "ckpt"),
        prune=True, clock=clock, trigger={"availableNow": True},
    )
    query.awaitTermination()
    assert query.exception() is None
    version, _ = table._version()
    assert version >= 3
    # 24-hour bans of earlier batches are gone, 7-day bans all there
    kept, whole = stored(table), expected_bans(spark, sf_dir, fx.PROFILE)
    long = lambda rows: [r for r in rows if r[1].startswith("file")]
    assert long(kept) == long(whole) and len(kept) < len(whole)


def test_restart_goes_on_from_the_checkpoint(spark, sf_dir, tmp_path):
    th = fx.PROFILE
    land(spark, sf_dir, str(tmp_path / "all"), 4)
    os.makedirs(tmp_path / "in")
    table = BanTable(spark, str(tmp_path / "bans"))
    for names in (("part-000.log", "part-001.log"), ("part-002.log", "part-003.log")):
        for name in names:
            os.link(tmp_path / "all" / name, tmp_path / "in" / name)
        run(spark, sf_dir, str(tmp_path / "in"), table, str(tmp_path / "ckpt"), th, per_trigger=2)
    assert stored(table) == expected_bans(spark, sf_dir, th)


def test_replayed_batch_adds_nothing(spark, tmp_path):
    table = BanTable(spark, str(tmp_path / "bans"))
    rows = spark.createDataFrame(
        [(5, 0, "192.0.2.1/24", "b"), (3, 0, "192.0.3.1/24", "b")],
        "seq long, kind int, prefix string, blame string",
    ).withColumn("expires_at", F.lit("2024-01-01").cast("timestamp"))
    table.add(rows, 0)
    table.add(rows, 1)
    before = sorted(map(tuple, table.records().collect()))
    table.add(rows, 1)
    assert sorted(map(tuple, table.records().collect())) == before
    assert [r[0] for r in before] == [1, 2, 3, 4]
    assert before[0][1] == "192.0.3.1/24"


def add_as_other_writer(frame, path):
    """Put files into a folder behind the session's back."""
    other = f"{path}-{uuid.uuid4().hex}"
    frame.write.parquet(other)
    for name in os.listdir(other):
        if name.endswith(".parquet"):
            os.link(os.path.join(other, name), os.path.join(path, name))


def test_inventory_refresh_shows_new_files(spark, sf_dir, tmp_path):
    path = str(tmp_path / "inventory")
    full = fx.inventory(spark, sf_dir)
    full.limit(0).write.parquet(path)
    now = [0.0]
    fresh = FreshInventory(spark, path, 100, clock=lambda: now[0])
    joined = fresh.frame
    assert joined.count() == 0
    add_as_other_writer(full, path)
    assert not fresh.refresh_if_due()
    assert joined.count() == 0
    now[0] = 101.0
    assert fresh.refresh_if_due()
    assert joined.count() == full.count()


def test_stream_sees_refreshed_inventory(spark, sf_dir, tmp_path):
    """Sizes that appear while the stream runs count from the next micro-batch on."""
    th = fx.PROFILE
    land(spark, sf_dir, str(tmp_path / "in"), 2)
    path = str(tmp_path / "inventory")
    full = fx.inventory(spark, sf_dir)
    full.limit(0).write.parquet(path)
    table = BanTable(spark, str(tmp_path / "bans"))
    fresh = FreshInventory(spark, path, 0)
    fresh.frame.count()
    add_as_other_writer(full, path)
    run(spark, sf_dir, str(tmp_path / "in"), table, str(tmp_path / "ckpt"), th, inventory=fresh)
    blames = {r.blame for r in table.records().select("blame").collect()}
    assert "file ratio bucket overflow" in blames
    assert len(stored(table)) < len(expected_bans(spark, sf_dir, th))


def test_quarantine_stream(spark, sf_dir, tmp_path):
    land(spark, sf_dir, str(tmp_path / "in"), 2)
    lines = read_log_lines(spark, str(tmp_path / "in"), stream=True)
    query = quarantine_stream(
        lines, str(tmp_path / "bad"), str(tmp_path / "ckpt"), trigger={"availableNow": True}
    )
    query.awaitTermination()
    _, rejects = parse_lines(fx.dirty_lines(spark, sf_dir))
    got = spark.read.parquet(str(tmp_path / "bad"))
    want = sorted(map(tuple, rejects.select("seq", "reject_reason").collect()))
    assert sorted(map(tuple, got.select("seq", "reject_reason").collect())) == want
