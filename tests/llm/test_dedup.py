import re

import numpy as np
import pytest

from leakguard.llm import dart_kernel, dart_minhash, exact_dedup, fuzzy_lines, mixing
from leakguard.llm.components import bucket_components, components, crowded_buckets

WHITE = re.compile(r"[\x20\x09-\x0D]")


def union_find(nodes, links):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("counters", [2, 256])
def test_exact_dedup_of_odd_rows(odd_docs, counters):
    got = exact_dedup.keep_decisions(odd_docs, counters).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(WHITE.sub("", r.text or ""), []).append(r)
    sizes = sorted(len(g) for g in groups.values() for _ in g)
    assert sorted(r.group_size for r in got) == sizes
    assert sum(r.kept for r in got) == len(groups)
    assert next(r.keep_id for r in got if r.doc_id == 4) == 5  # longest original, then smallest id
    assert next(r.keep_id for r in got if r.doc_id == 1) == 3
    kept = exact_dedup.exact_dedup(odd_docs, counters)
    assert kept.columns == odd_docs.columns and kept.count() == len(groups)


def test_summary_keeps_frequent_digests():
    from collections import Counter

    counts = exact_dedup.shrink(Counter({b"a": 50, b"b": 30, **{bytes([200, i]): 1 for i in range(100)}}), 4)
    assert len(counts) <= 4 and counts.keys() >= {b"a", b"b"}


def test_no_documents(no_docs):
    assert exact_dedup.keep_decisions(no_docs).count() == 0
    assert dart_minhash.near_classes(no_docs).count() == 0
    assert fuzzy_lines.line_report(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == union_find({n for p in links for n in p}, links)


def test_bucket_components_lose_no_link(spark):
    rng = np.random.default_rng(3)
    place = {n: float(rng.uniform(0, 40)) for n in range(120)}
    members = [(b, n) for n in place for b in {int(place[n] // 10), 10 + int((place[n] + 5) // 10)}]
    frame = spark.createDataFrame([(b, n, place[n]) for b, n in members], "bucket bigint, node bigint, trait double")
    near = lambda x, y: f"abs({x} - {y}) <= 0.3"
    got = bucket_components(crowded_buckets(frame), near, lambda pairs: pairs)
    same = {(a, b) for x, a in members for y, b in members if x == y and a < b and abs(place[a] - place[b]) <= 0.3}
    want = {n: t for n, t in union_find(place, same).items() if any(n in p for p in same)}
    assert {r.node: r.label for r in got.collect()} == want


def shingle_sets(texts):
    cells, owner = dart_kernel.elements(texts)
    return [set(cells[owner == i].tolist()) for i in range(len(texts))]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_elements_are_counted_shingles():
    text = "A b c d e, a b c d e! A-b c d e é_1"
    words = re.findall(r"[a-z0-9_é]+", text.lower())
    assert len(shingle_sets([text])[0]) == len(words) - 4
    assert len({frozenset(s) for s in shingle_sets(["a b c d e f", "A, B c d e f", "a b c d f e"])}) == 2
    assert [len(s) for s in shingle_sets(["", "??", "one", "one two", "a b c d e"])] == [0, 0, 1, 1, 1]


def test_coordinates_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 300, 400)]
    other = [w if rng.random() > 0.03 else "x" for w in base]
    a, b = shingle_sets([" ".join(base), " ".join(other)])
    cells, owner = dart_kernel.elements([" ".join(base), " ".join(other)])
    marks = dart_kernel.signatures(cells, owner, 2, 4096)
    assert abs((marks[0] == marks[1]).mean() - jaccard(a, b)) < 0.04
    # weights: 1.5 against 1 on one of two elements
    cells = np.array([11, 22, 33, 11, 22], np.uint64)
    marks = dart_kernel.signatures(cells, np.array([0, 0, 0, 1, 1]), 2, 8192, np.array([1.0, 1.0, 0.5, 1.0, 1.0]))
    assert abs((marks[0] == marks[1]).mean() - 2 / 2.5) < 0.02


@pytest.mark.parametrize("large", [2, 32])
def test_near_classes_equal_brute_force(spark, docs, monkeypatch, large):
    monkeypatch.setattr(dart_minhash, "LARGE_BUCKET", large)
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in rng.integers(0, 5000, 120)]
    edits = [(5000 + i, " ".join(w if rng.random() > 0.012 else f"e{i}" for w in base)) for i in range(60)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(edits, "doc_id bigint, text string"))
    rows = table.collect()
    sets = shingle_sets([r.text for r in rows])
    links = [
        (rows[i].doc_id, rows[j].doc_id)
        for i in range(len(rows))
        for j in range(i)
        if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= 0.8
    ]
    want = union_find([r.doc_id for r in rows], links)
    got = dart_minhash.near_classes(table).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_near_dedup_of_odd_rows(odd_docs):
    got = dart_minhash.near_classes(odd_docs)
    assert got.count() == odd_docs.count()
    by_id = {r.doc_id: r.class_id for r in got.collect() if r.doc_id is not None}
    assert by_id[8] == by_id[7] and by_id[1] == by_id[2] == by_id[3] == 1 and by_id[5] == by_id[6] == 4
    kept = dart_minhash.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == got.filter("kept").count()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_classes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit") for b in ("em", "um", "or", "am", "et")]
    base = [" ".join(rng.choice(words, 60)) for _ in range(6)]
    lines = []
    for b in base:
        for _ in range(6):
            w = b.split()
            for i in rng.integers(0, len(w), rng.integers(0, 3)):
                w[i] = str(rng.choice(words))
            lines.append(" ".join(w).title() + "!")
    lines += ["one two", "One, two", "", "  ", "..."]
    order = rng.permutation(len(lines))
    texts = ["\n".join(lines[i] for i in order[k::4]) for k in range(4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r.doc_id, r.line_no): r for r in fuzzy_lines.line_classes(docs).collect()}
    places = [(d, n) for d, t in enumerate(texts) for n in range(len(t.split("\n")))]
    assert sorted(got) == sorted(places)
    norm = {p: re.sub(r"[\W_]+", " ", texts[p[0]].split("\n")[p[1]].lower()).strip() for p in places}
    links = []
    for p in places:
        for q in places:
            if p < q and norm[p] and norm[q]:
                longest = max(len(norm[p]), len(norm[q]))
                if norm[p] == norm[q] or edit_distance(norm[p], norm[q]) <= 0.2 * longest + 1e-9:
                    links.append((p, q))
    want = union_find(places, links)
    assert any(norm[a] != norm[b] for a, b in links)
    assert {p for p in places if got[p].kept} == {p for p in places if not norm[p] or want[p] == p}
    for p in places:
        for q in places:
            if norm[p] and norm[q]:
                assert (got[p].class_id == got[q].class_id) == (want[p] == want[q])


def test_lines_of_odd_rows(odd_docs):
    out = fuzzy_lines.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    report = fuzzy_lines.line_report(odd_docs).collect()
    assert len(report) == odd_docs.count()
    assert sum(r.n_kept for r in report if r.doc_id in (4, 5, 6)) == 1


def test_poisson_counts():
    for mean in (0.0, 0.3, 1.0, 7.5, 100.0, 4096.0):
        first, cdf = mixing.poisson_cdf(mean)
        assert abs(first + sum(1 - p for p in cdf) - mean) < 1e-6


@pytest.mark.parametrize("mean", [1_000, 10_000])
def test_large_means_are_poisson(spark, mean):
    """A tiny source with a large target: mean and variance are the rate."""
    docs = spark.range(4_000).selectExpr("id as doc_id", "'x' as text", "'tiny' as source")
    counts = mixing.repetitions(docs, {"tiny": 1.0}, budget=float(mean)).select("repeat").toPandas()["repeat"]
    assert abs(counts.mean() - mean) < 5 * (mean / 4_000) ** 0.5
    assert 0.9 < counts.var() / mean < 1.1


def test_share_of_absent_sources_goes_to_the_others(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 10) as text", "if(id % 2 = 0, 'a', 'z') as source")
    out = mixing.mix(docs, {"a": 0.2, "b": 0.3, "c": 0.3}, budget=1.0)
    rows = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(sum(rows.values()) - 20_000) < 700 and abs(rows["a"] / sum(rows.values()) - 0.5) < 0.02
    assert mixing.mix(docs, {"b": 1.0}).count() == 0
    named = docs.selectExpr("*", "7 as copy", "8 as mix_key")
    got = mixing.mix(named, {"a": 0.2})
    assert got.columns == ["doc_id", "text", "source", "copy", "mix_key", "_copy", "_mix_key"]
    assert {(r["copy"], r["mix_key"]) for r in got.select("copy", "mix_key").distinct().collect()} == {(7, 8)}


def test_mixing_reaches_the_targets(spark):
    docs = spark.range(60_000).selectExpr(
        "id as doc_id", "repeat('x', 10) as text", "case when id % 3 = 0 then 'big' else concat('s', id % 50) end as source"
    )
    out = mixing.mix(docs, {"big": 0.1, "s1": 0.3}, budget=0.5)
    rows = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(rows.values())
    assert abs(total - 30_000) < 900
    assert abs(rows["big"] / total - 0.1) < 0.01 and abs(rows["s1"] / total - 0.3) < 0.02
    again = mixing.mix(docs.repartition(7), {"big": 0.1, "s1": 0.3}, budget=0.5)
    assert again.select("doc_id", "copy").exceptAll(out.select("doc_id", "copy")).count() == 0
    keys = [r.mix_key for r in out.select("mix_key").limit(2000).collect()]
    assert keys == sorted(keys)


def test_mixing_equals_a_plain_inverse(docs):
    import hashlib
    from math import exp

    rates = mixing.rates(docs, mixing.TARGETS, 1.0)
    got = {r.doc_id: r["repeat"] for r in mixing.repetitions(docs).collect()}
    for r in docs.collect():
        mean = rates[r.source if r.source in mixing.TARGETS else None]
        u = int(hashlib.md5(f"copies{mixing.SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, exp(-mean)
        total = term
        while total <= u:
            k += 1
            term *= mean / k
            total += term
        assert got[r.doc_id] == k


def test_mixing_of_odd_rows(odd_docs):
    out = mixing.mix(odd_docs, {"src0": 0.5, "src7": 0.1}, budget=40.0)
    assert out.columns == [*odd_docs.columns, "copy", "mix_key"]
    assert out.groupBy("doc_id").count().filter("count > 0").count() == 12
