import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakguard.llm import chat, pii, topk, toxicity, toxicity_kernel
from leakguard.llm.queries import QUERIES


def brute_top(rows, k):
    scaled = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in rows}
    out = set()
    for q, _ in rows:
        if q % 10 == 0:
            limit = (1 << 63) - 1
            held = lambda x: max(-limit - 1, min(limit, x))
            scores = [(-held(sum(a * b for a, b in zip(scaled[q], v))), i) for i, v in scaled.items() if i != q]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", block)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(6)] + [(200, [1e30] * 20), (201, [0.0] * 20)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    from pyspark.sql import functions as F

    got = {tuple(r) for r in topk.top_k(frame, F.col("id") % 10 == 0, 5).collect()}
    assert got == brute_top(rows, 5)


def test_top_k_of_odd_vectors(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, [1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, None), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("norm", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("id") % 10 == 0, 10).collect())
    s = 1 << 20
    assert got == [(0, 1, 7, 5 * s), (0, 2, 7, 5 * s), (0, 3, 10, s), (0, 4, 8, 0), (10, 1, 0, s), (10, 2, 7, s), (10, 3, 7, s), (10, 4, 8, 0)]
    assert topk.top_k(frame.limit(0), F.col("id") % 10 == 0).count() == 0


TEXT = st.lists(st.sampled_from(["<", "|", "<|im_end|>", "<|im_start|>", "\n", "a", "<||", "<|n|", "user"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXT), TEXT), max_size=5))
def test_template_is_reversible(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    rows = [
        (1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "a1", 0.2), (1, 2, 0, "assistant", "a2", 0.9),
        (1, 3, 2, "user", "more", 0.1), (1, 4, 99, "user", "orphan", None), (1, 5, 5, "user", "own parent", 0.0),
        (2, 0, None, None, None, None), (None, 1, None, "user", "no id", 1.0),
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, parent bigint, role string, text string, score double")
    got = chat.format_trees(frame).collect()
    paths = sorted((r.conv_id or 0, r.path_rank, [t for _, t in chat.parse(r.formatted)]) for r in got)
    assert paths == [
        (0, 1, ["no id"]),
        (1, 1, ["q", "a2", "more"]), (1, 2, ["q", "a1"]), (1, 3, ["orphan"]), (1, 4, ["own parent"]),
        (2, 1, [""]),
    ]
    assert chat.format_trees(frame, best=1).count() == 3


def test_long_chains_and_ties(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(300)] + [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "user", "first")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as node", "2 as leaf", "3 as up")
    got = {r.conv_id: [t for _, t in chat.parse(r.formatted)] for r in chat.format_trees(frame).collect()}
    assert got == {1: [f"t{t}" for t in range(300)], 2: ["first", "a", "a", "b"]}
    assert chat.format_trees(frame.limit(0)).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def plain_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]:
                out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans_equal_plain_patterns(spark, docs):
    rng = np.random.default_rng(8)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256", "+1 (222) 333-4444", "4111 1111 1111 1111", " ", "-", "9", "+", "é", "x.y", "0", "\U0001f600", "4242-4242-4242-4242"]
    mixed = ["".join(rng.choice(parts, 12)) for _ in range(150)]
    # short: the plain patterns take quadratic time here
    mixed += ["x" * 2_000 + "@y.z", "1." * 1_000, "+" * 2_000 + "1", "1 " * 2_000, "9" * 2_000]
    extra = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(mixed)], "doc_id bigint, text string")
    table = docs.select("doc_id", "text").union(extra)
    got = pii.personal_data(table).collect()
    want = sorted((r.doc_id, hashlib.sha256(",".join(plain_spans(r.text)).encode()).hexdigest()) for r in table.collect())
    assert sorted((r.doc_id, r.base_sha256) for r in got) == want
    whole = {r.doc_id: r.text for r in table.collect()}
    for r in got:
        assert set(plain_spans(whole[r.doc_id])) <= set(r.spans.split(","))


def test_personal_data_of_odd_rows(odd_docs, no_docs):
    got = pii.personal_data(odd_docs)
    assert got.count() == odd_docs.count() and got.filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert pii.personal_data(no_docs).count() == 0


def test_trees_and_thresholds_take_all_proposals(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    texts = ["; ".join(f"a{i}x{k}@b.co; {i * 50 + k}" for k in range(50)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fit, thresholds, taken = GBTClassifier.fit, pii._thresholds, {}

    def counted(name, own):
        def call(*args):
            taken[name] = args[-1].count()
            return own(*args)

        return call

    monkeypatch.setattr(GBTClassifier, "fit", counted("trees", fit))
    monkeypatch.setattr(pii, "_thresholds", counted("thresholds", thresholds))
    assert pii.find_spans(docs).count() == 200
    # an address and three numbers, as a number is proposed within an address too
    assert sum(taken.values()) == 200 * 50 * 4 and 12_500 < taken["thresholds"] < 14_000


def test_thresholds_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(str(rng.choice(pii.KINDS[:3])), int(s), float(rng.random() < (s / 4_096) ** 0.02)) for s in rng.integers(0, 4_097, 9_000)]
    rows += [("phone", 3_000, 1.0)] * (pii.MIN_SUPPORT - 1)

    def lowest(part):
        good = [x for x in {s for _, s, _ in part} if len(y := [v for _, s, v in part if s >= x]) >= pii.MIN_SUPPORT and sum(y) >= pii.PRECISION * len(y)]
        return min(good)

    got = pii._thresholds(spark.createDataFrame(rows, "kind string, step int, label double"))
    together = lowest(rows)
    want = {k: max(together, 2_048, lowest([r for r in rows if r[0] == k]) if k != "phone" else 0) for k in pii.KINDS}
    assert got == want


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a@b.co at 10.0.0.1."), (2, None), (3, "clean")], "doc_id bigint, text string").selectExpr("*", "1 as of", "2 as listed")
    out = pii.redact(docs, pii.find_spans(docs))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "to [email] at [ip].", 2: "", 3: "clean"} and out.columns == docs.columns


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    votes = np.zeros((3000, 5), int)
    for v, right in enumerate((0.95, 0.9, 0.8, 0.8)):
        says = np.where(rng.random(3000) < right, y, ~y)
        votes[:, v] = np.where(rng.random(3000) < 0.7, says + 1, 0)
    votes[:, 4] = votes[:, 3]  # says what another says
    gold = np.where(rng.random(3000) < 0.1, y.astype(int), -1)
    q, model = toxicity_kernel.label_model(votes, gold, np.ones(3000))
    assert ((q > 0.5) == y).mean() > 0.95
    assert model["voice"][3] == model["voice"][4] == 0.5 and model["voice"][0] == 1.0


def test_toxicity_on_held_out_documents(spark):
    words = ["stone", "river", "cloud", "green", "quiet", "letter"]
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1200):
        text = list(rng.choice(words, 30))
        toxic = i % 8 == 0
        if toxic:
            text += ["zorb" + s for s in rng.choice(["un", "ig", "ak", "et"], 3)] if i % 16 else ["You", "idiot"]
        rows.append((i, " ".join(text) + f" n{i}", int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert 200 < len(held) < 400 and all(r.predicted == y for r, y in held)
    kept = toxicity.drop_toxic(docs.selectExpr("*", "1 as toxicity"), labels)
    assert kept.columns == ["doc_id", "text", "toxicity"]
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(odd_docs, labels)
    assert got.count() == odd_docs.count() and got.filter("score between 0 and 1 and held_out is not null").count() == got.count()
    assert toxicity.score_documents(no_docs, labels).count() == 0
    assert toxicity.score_documents(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_pipeline_equals_its_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == docs.columns, name
        if name != "mixing":
            assert after.select("doc_id").exceptAll(kept.select("doc_id")).count() == 0
        kept = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    got = QUERIES["pipeline"](spark, sf_dir)
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert rows(got) == rows(packed)


def test_pipeline_stages_of_odd_and_empty_tables(spark, odd_docs, no_docs, sf_dir):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    n = odd_docs.count()
    for name in ("toxicity", "exact dedup", "MinHash near-dedup", "mixing"):
        for docs in (odd_docs, no_docs):
            out = stages[name](spark, docs, sf_dir)
            assert out.columns == docs.columns
            # mixing draws counts; the other stages only drop rows
            assert name == "mixing" or out.count() <= (n if docs is odd_docs else 0)
        assert stages[name](spark, no_docs, sf_dir).count() == 0
    kept = stages["exact dedup"](spark, odd_docs, sf_dir).collect()
    # empty, null and blank texts are one group, the three spellings of one text another
    assert sum((r.text or "").strip() == "" for r in kept) == 1
    assert sum((r.text or "").replace(" ", "") == "onetwothree" for r in kept) == 1
    packed = stages["packing"](spark, odd_docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in odd_docs.select("doc_id").collect()}
    assert stages["packing"](spark, no_docs, sf_dir).count() == 0
