"""Routes, sizes, skewed lookups, statistics and plan shapes."""

import pytest
from pyspark.sql import functions as F

from leakguard.functions.paths import ratio_cost, url_rest, url_tag
from leakguard.operators import buckets, levels, resolve, stats
from leakguard.operators.skew import lookup_join
from leakguard.schemas import Thresholds
from leakguard.sources import fixtures as fx


@pytest.mark.parametrize(
    "url,tag,rest",
    [
        ("/en/25", "en", "/25"), ("en/25", "en", "/25"), ("/en", None, None), ("/", None, None),
        ("//x", "", "/x"), ("", None, None), ("/ü/é/日", "ü", "/é/日"), ("/en/", "en", "/"), (None, None, None),
    ],
)
def test_url_split(spark, url, tag, rest):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(df.select(url_tag(F.col("url")), url_rest(F.col("url"))).first()) == (tag, rest)


def world(spark):
    requests = spark.createDataFrame(
        [
            (1, "/en/file", 50), (2, "/en/none", 50), (3, "/de/1", 50), (4, "/en", 50),
            (5, "/en/dir", 50), (6, "/en/empty", 50), (7, "/en/err", 50), (8, "/fr/file", 10),
            (9, "", 1),
        ],
        "seq long, url string, sent long",
    )
    routes = spark.createDataFrame([("en", "/d/en"), ("fr", "/d/fr/")], "tag string, root string")
    inventory = spark.createDataFrame(
        [
            ("/d/en/file", 30, False), ("/d/en/dir", None, True), ("/d/en/empty", 0, False),
            ("/d/en/err", None, False), ("/d/fr/file", 1000, False),
        ],
        "path string, size long, is_dir boolean",
    )
    return requests, routes, inventory


@pytest.mark.parametrize("options", [{}, {"hot_limit": 2}])
def test_outcomes(spark, options):
    requests, routes, inventory = world(spark)
    out = resolve.resolve_sizes(requests, routes, inventory, **options)
    assert {r.seq: r.outcome for r in out.collect()} == {
        1: "SIZE", 2: "MISSING", 3: "NO_ROUTE", 4: "NO_ROUTE", 5: "IS_DIR", 6: "EMPTY",
        7: "ERROR", 8: "SIZE", 9: "NO_ROUTE",
    }
    tracked = {r.seq: r.ratio_cost for r in resolve.trackable(out).collect()}
    assert tracked == {1: 166666, 8: 1000}
    rest = resolve.untracked(requests, routes, inventory, **options)
    assert {r.seq for r in rest.collect()} == {2, 3, 4, 5, 6, 7, 9}


@pytest.mark.parametrize("how", ["left", "left_anti", "inner"])
def test_hot_lookup_equals_plain_join(spark, how):
    left = spark.range(3000).selectExpr(
        "id as seq", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else cast(id % 50 as string) end as k"
    )
    right = spark.range(40).selectExpr("cast(id as string) as k", "id as v").unionByName(
        spark.createDataFrame([("hot", 99)], "k string, v long")
    )
    plain = left.join(right, "k", how)
    got = lookup_join(left, right, "k", how, hot_limit=100)
    cols = sorted(plain.columns)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))


def test_ratio_cost_does_not_overflow(spark):
    df = spark.createDataFrame([(2**62, 2**40)], "sent long, size long")
    assert df.select(ratio_cost(F.col("sent"), F.col("size"))).first()[0] == 2**62 * 100000 // 2**40


def test_fresh_sizes(spark):
    snaps = spark.createDataFrame(
        [
            ("a", 1, False, 0, False), ("a", 2, False, 50, False), ("a", None, False, 60, True),
            ("b", None, False, 50, False), ("c", 9, False, 0, False), ("d", None, True, 40, False),
        ],
        "path string, size long, is_dir boolean, at long, error boolean",
    ).withColumn("scanned_at", F.timestamp_seconds("at"))
    now = F.timestamp_seconds(F.lit(100))
    got = {r.path: (r.size, r.is_dir) for r in resolve.fresh_sizes(snaps, now, 60).collect()}
    assert got == {"a": (2, False), "b": (None, False), "d": (None, True)}


def test_stats_with_empty_inputs(spark, sf_dir):
    requests = fx.requests(spark, sf_dir).limit(0)
    tracked = requests.withColumn("ratio_cost", F.lit(0))
    bans = spark.createDataFrame([], "prefix string, blame string, expires_at timestamp")
    row = stats.tracking_stats(requests, tracked, bans).first()
    assert set(row.asDict().values()) == {0}


def test_thresholds_are_checked():
    for bad in ({"v4_prefix": 33}, {"v6_prefix": -1}, {"idle_reset_s": 0}, {"dst_ports": (70000,)},
                {"byte_leak": -1}):
        with pytest.raises(ValueError):
            Thresholds(**bad)
    assert Thresholds(prune_interval_s=5).prune_interval_s == 60


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_for_levels_and_bans(spark, sf_dir, tmp_path):
    # stored, so that the plans hold the operators alone and not how the fixture counts pages
    fx.requests(spark, sf_dir).write.parquet(str(tmp_path / "requests"))
    requests = spark.read.parquet(str(tmp_path / "requests"))
    for df in (
        levels.client_levels(requests, fx.PROFILE),
        levels.client_levels(requests, fx.PROFILE, floor=True),
        buckets.client_bans(requests, fx.PROFILE),
        buckets.client_bans(requests, fx.PROFILE, prefilter=False),
    ):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1, text
        assert text.count("+- Sort ") == 1, text
        assert "SinglePartition" not in text


def test_small_lookups_are_broadcast_and_scans_are_narrow(spark, sf_dir):
    resolved = resolve.resolve_sizes(
        fx.requests(spark, sf_dir), fx.routes(spark, sf_dir), fx.inventory(spark, sf_dir)
    ).select("seq", "outcome")
    text = plan(resolved)
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") >= 3
    assert "event_type" not in text.split("FileScan parquet")[1].split("ReadSchema")[1].split("\n")[0]


def test_ratio_cost_is_held_at_the_largest_long(spark):
    from leakguard.functions.paths import ratio_cost

    top = (1 << 63) - 1
    rows = spark.createDataFrame([(top, 1), (top, top), (5, 2), (None, 3), (0, 7)], "sent long, size long")
    got = [r[0] for r in rows.select(ratio_cost(F.col("sent"), F.col("size"))).collect()]
    assert got == [top, 100_000, 250_000, None, 0]
