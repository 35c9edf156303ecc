"""Address, prefix and CIDR expressions against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from leakguard.functions import net
from leakguard.operators import cidr
from leakguard.operators.bans import BanTable, manual_bans, number_bans, valid_prefixes
from leakguard.operators.skew import number_rows
from leakguard.plans.rules import assemble_rules, compile_rules, rule_entries, rules_json


def key_of(text):
    ip = ipaddress.ip_address(text.split("%")[0])
    n = int(ip) if ip.version == 6 else int(ip) + 0xFFFF00000000
    return f"{n:032x}"


GOOD = [
    "1.2.3.4", "255.255.255.255", "0.0.0.0", "::", "::1", "2001:db8::1", "2001:DB8:0:0:1::A",
    "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "fe80::1%eth0", "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:1.2.3.4", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
]
BAD = [
    "", "01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", "unix:", "1.2.3.4%eth0", ":::", "1::2::3",
    "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::1", "fe80::1%", "::1.2.3", "1:2:3:4:5:6:7:8::",
    "1.2.3.4 ", "999.1.1.1", "::x.y", "a.b:c.d", "::99999999999999999999.1.1.1", ":1.2.3.4", ".:.",
]


def test_address_key(spark):
    rng = random.Random(1)
    texts = GOOD + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(50)]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(20) << rng.choice([0, 40, 100]))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts + BAD], "a string")
    got = {r.a: r.h for r in df.select("a", net.address_hex("a").alias("h")).collect()}
    for t in texts:
        assert got[t] == key_of(t), t
    for t in BAD:
        assert got[t] is None, t
    fam = df.select("a", net.address_family("a").alias("f")).filter("a in ('1.2.3.4', '::1', '::ffff:1.2.3.4')")
    assert {r.a: r.f for r in fam.collect()} == {"1.2.3.4": 4, "::1": 6, "::ffff:1.2.3.4": 6}


def test_v6_text(spark):
    rng = random.Random(2)
    values = [0, 1, 1 << 127, (1 << 128) - 1, 0x20010DB8 << 96]
    for _ in range(300):
        v = 0
        for _ in range(8):
            v = v << 16 | (rng.getrandbits(16) if rng.random() < 0.5 else 0)
        values.append(v)
    df = spark.createDataFrame([(f"{v:032x}",) for v in values], "h string")
    for r in df.select("h", net.v6_text("h").alias("t")).collect():
        assert r.t == str(ipaddress.IPv6Address(int(r.h, 16))), r


def test_ban_prefix_of_mapped_and_zoned_addresses(spark):
    df = spark.createDataFrame(
        [("::ffff:1.2.3.4",), ("fe80::1%eth0",), ("1.2.3.4",)], "a string"
    ).select("a", net.address_key("a").alias("k"), net.address_family("a").alias("f"))
    plain = df.select("a", net.ban_prefix("k", "f", 24, 48).alias("p"))
    assert {r.a: r.p for r in plain.collect()} == {
        "::ffff:1.2.3.4": "::ffff:1.2.3.4/48",
        "fe80::1%eth0": "fe80::1/48",
        "1.2.3.4": "1.2.3.4/24",
    }
    unmapped = df.select("a", net.ban_prefix("k", "f", 24, 48, True).alias("p"))
    assert {r.a: r.p for r in unmapped.collect()}["::ffff:1.2.3.4"] == "1.2.3.4/24"


def test_prefix_ranges(spark):
    rng = random.Random(3)
    good = ["1.2.3.4/24", "1.2.3.4/32", "0.0.0.0/0", "2001:db8::/48", "::/0", "::1/128"]
    good += [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randrange(33)}" for _ in range(60)]
    good += [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{rng.randrange(129)}" for _ in range(60)]
    bad = ["invalid Prefix", "1.2.3.4", "1.2.3.4/33", "1.2.3.4/024", "::/129", "fe80::1%e/64", "1.2.3.4/", ""]
    df = spark.createDataFrame([(p,) for p in good + bad], "prefix string")
    got = {r.prefix: r for r in cidr.prefix_ranges(df).collect()}
    for p in good:
        n = ipaddress.ip_network(p, strict=False)
        off = 0xFFFF00000000 if n.version == 4 else 0
        assert got[p].family == n.version
        assert int(got[p].lo, 16) == int(n.network_address) + off, p
        assert int(got[p].hi, 16) == int(n.broadcast_address) + off, p
    for p in bad:
        assert got[p].lo is None, p
    assert valid_prefixes(df).count() == len(good)


def random_prefixes(rng, version):
    width = 32 if version == 4 else 128
    make = ipaddress.IPv4Network if version == 4 else ipaddress.IPv6Network
    base = rng.getrandbits(width)
    out = []
    for _ in range(rng.randrange(1, 25)):
        bits = rng.choice([0, 1, 3, 8, 15, 16, 24, 25, 28, 31, 32] if version == 4 else
                          [0, 8, 12, 16, 17, 32, 47, 48, 49, 64, 127, 128])
        if bits < 4 and rng.random() < 0.9:
            bits = 24
        step = rng.randrange(6) << (width - bits) if bits else 0
        net_ = make(((base + step) % (1 << width), bits), strict=False)
        out.append(net_)
    return out


@pytest.mark.parametrize("version", [4, 6])
def test_tiles_equal_collapse(spark, version):
    """Splitting islands, many at once: the islands come from the library here."""
    rng = random.Random(version)
    rows, expected = [], {}
    off = 0xFFFF00000000 if version == 4 else 0
    for n in range(200):
        nets = list(ipaddress.collapse_addresses(random_prefixes(rng, version)))
        islands = []
        for net_ in sorted(nets):
            s, e = int(net_.network_address), int(net_.broadcast_address) + 1
            if islands and islands[-1][1] == s:
                islands[-1][1] = e
            else:
                islands.append([s, e])
        expected[n] = sorted(str(x) for x in nets)
        rows += [(n, version, f"{s + off:033x}", f"{e + off:033x}") for s, e in islands]
    df = spark.createDataFrame(rows, "n int, family int, start string, end string")
    tiles = df.select(
        "n", "family", net.hex33_bits("start").alias("s"), net.hex33_bits("`end`").alias("e")
    ).select("n", "family", F.explode(F.expr(cidr._TILES)).alias("t"))
    got = {}
    for r in tiles.select("n", net.prefix_text("family", "t.hex32", "t.bits").alias("p")).collect():
        got.setdefault(r.n, []).append(r.p)
    assert {n: sorted(v) for n, v in got.items()} == expected


@pytest.mark.parametrize("seed", range(4))
def test_minimal_prefixes_equal_collapse(spark, seed):
    rng = random.Random(100 + seed)
    v4, v6 = random_prefixes(rng, 4), random_prefixes(rng, 6)
    if seed == 3:  # a short IPv6 prefix covering others, and everything in IPv4
        v6 += [ipaddress.IPv6Network("2000::/3"), ipaddress.IPv6Network("2001:db8::/48")]
        v4 += [ipaddress.IPv4Network("0.0.0.0/0")]
    texts = [str(p) for p in v4 + v6 + v4[:2]] + ["invalid Prefix"]
    df = spark.createDataFrame([(t,) for t in texts], "prefix string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r.prefix for r in cidr.minimal_prefixes(df).orderBy("family", "lo").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [str(p) for nets in (v4, v6) for p in ipaddress.collapse_addresses(nets)]
    assert got == want


def ban_frame(spark, prefixes, expires="2024-01-03"):
    return spark.createDataFrame(
        [(i, p, "b") for i, p in enumerate(prefixes)], "seq long, prefix string, blame string"
    ).withColumn("expires_at", F.lit(expires).cast("timestamp"))


def test_rules(spark):
    bans = ban_frame(spark, ["192.0.2.9/24", "192.0.3.0/24", "2001:db8::1/48", "x", "10.0.0.0/8"])
    now = "2024-01-02 00:00:00"
    rule = compile_rules(bans, now).collect()
    assert [(r.prefixes, r.dst_ports) for r in rule] == [
        (["10.0.0.0/8", "192.0.2.0/23", "2001:db8::/48"], [80, 443])
    ]
    text = rules_json(compile_rules(bans, now)).first()[0]
    assert text == '{"prefixes":["10.0.0.0/8","192.0.2.0/23","2001:db8::/48"],"dst_ports":[80,443]}'
    none = compile_rules(bans, "2024-01-04").collect()
    assert [(r.prefixes, r.dst_ports) for r in none] == [([], [80, 443])]


def test_rule_and_entries_agree(spark):
    bans = ban_frame(spark, [f"10.{i}.0.0/24" for i in range(20)])
    minimal = cidr.minimal_prefixes(bans)
    (rule,) = assemble_rules(minimal).collect()
    entries = rule_entries(minimal).orderBy("family", "lo").collect()
    assert rule.prefixes == [r.prefix for r in entries] == [f"10.{i}.0.0/24" for i in range(20)]
    assert all(r.dst_ports == rule.dst_ports for r in entries)


def test_numbers_keep_rows_without_seq(spark):
    rows = spark.createDataFrame([(None,), (5,), (None,), (900,)], "seq long")
    got = number_rows(rows, [F.col("seq")], "id", limit=3).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4]
    assert [r.id for r in got if r.seq == 900] == [4]


def test_number_bans_across_spans(spark):
    client = ban_frame(spark, ["c"] * 10)
    path = ban_frame(spark, ["p"] * 10)
    rows = number_bans(client, path, offset=100, limit=3).orderBy("id").collect()
    assert [(r.id, r.seq, r.kind) for r in rows] == [
        (101 + 2 * s + k, s, k) for s in range(10) for k in (0, 1)
    ]


def test_manual_bans(spark):
    lines = [
        '{"prefix":"192.0.2.0/24","blame":"x","expires_at":"2024-01-02T03:04:05Z","id":7}',
        '{"prefix":"nope","blame":"x","expires_at":"2024-01-02T03:04:05Z"}',
        '{"prefix":"192.0.2.0/24","blame":"x","expires_at":"soon"}',
        "{bad",
        '{"prefix":"::/0","blame":"y","expires_at":"2024-01-02T03:04:05+01:00"}',
    ]
    good, bad = manual_bans(spark.createDataFrame([(t,) for t in lines], "line string"))
    assert "id" not in good.columns
    got = {r.prefix: r.u for r in good.selectExpr("prefix", "unix_seconds(expires_at) u").collect()}
    assert got == {"192.0.2.0/24": 1704164645, "::/0": 1704161045}
    assert bad.count() == 3


def test_ban_table(spark, tmp_path):
    table = BanTable(spark, str(tmp_path / "t"))
    assert table.records().count() == 0
    old = ban_frame(spark, ["10.0.0.0/8", "x"], "2024-01-01")
    new = ban_frame(spark, ["10.1.0.0/16", "10.2.0.0/16", "x"], "2024-01-05")
    table.add(old)
    table.add(new.drop("seq"))
    now = "2024-01-02"
    assert sorted(r.id for r in table.records().collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.prefix for r in table.list(now).collect()) == ["10.1.0.0/16", "10.2.0.0/16"]
    gone = [r.id for r in table.list(now).filter("prefix = '10.2.0.0/16'").collect()]
    table.delete(spark.createDataFrame([(i,) for i in [*gone, 0, -1]], "id long"))
    assert [r.prefix for r in table.list(now).collect()] == ["10.1.0.0/16"]
    assert table.compile(now).first().prefixes == ["10.1.0.0/16"]
    table.prune(now)
    assert sorted(r.prefix for r in table.records().collect()) == ["10.1.0.0/16", "x"]
    # ids are never used again, not even those of pruned records
    table.prune("2024-02-01")
    assert table.records().count() == 0
    table.add(new)
    assert sorted(r.id for r in table.records().collect()) == [6, 7, 8]
