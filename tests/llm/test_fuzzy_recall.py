import random
import re

from pyspark.sql import functions as F

from leakguard.llm import fuzzy_lines
from tests.llm.test_dedup import union_find


def near_pairs(spark, norms):
    """All pairs of at least the edit similarity, by comparing each line with each."""
    table = spark.createDataFrame(list(enumerate(norms)), "n int, t string")
    a, b = table.toDF("a", "l").repartition(16), table.toDF("b", "r")
    longest = "greatest(length(l), length(r))"
    allowed = f"cast(floor(0.2D * {longest} + 1e-9D) as int)"
    both = a.crossJoin(b).filter(f"a < b and abs(length(l) - length(r)) <= {allowed}")
    return [(r.a, r.b) for r in both.filter(f"levenshtein(l, r, {allowed}) >= 0").select("a", "b").collect()]


def classes_of(spark, lines):
    docs = spark.createDataFrame([(0, "\n".join(lines))], "doc_id bigint, text string")
    return {r.line_no: r.class_id for r in fuzzy_lines.line_classes(docs).collect()}


def test_recall_of_real_lines(spark, docs):
    """Against edit similarity alone: lines of the given documents."""
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    norms = sorted({n for r in docs.collect() for x in (r.text or "").split("\n") if 0 < len(n := norm(x)) <= 600})[::2]
    norms += [" ".join("abc" if i == k % 9 else w for i, w in enumerate(n.split())) for k, n in enumerate(norms[::4]) if len(n.split()) > 8]
    norms = list(dict.fromkeys(norms))
    pairs = near_pairs(spark, norms)
    got = classes_of(spark, norms)
    found = sum(got[a] == got[b] for a, b in pairs)
    print(f"lines {len(norms)}, pairs {len(pairs)}, found {found}")
    assert len(pairs) > 50 and found >= 0.95 * len(pairs)
    want = union_find(range(len(norms)), pairs)
    by_class = {}
    for n, c in got.items():
        by_class.setdefault(c, set()).add(want[n])
    assert all(len(tops) == 1 for tops in by_class.values())  # nothing is linked below the similarity


def test_short_lines_and_lines_of_few_or_short_words(spark):
    """No hash was made of such lines."""
    short = ["abcde", "abxde", "ab", "ax", "to be or no", "to be or so", "abcdefghij", "abcdefgxyj", "a b c d e f", "a b d e f"]
    got = classes_of(spark, short)
    pairs = near_pairs(spark, short)
    assert len(pairs) == 4
    want = union_find(range(len(short)), pairs)
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in got for b in got)
    small = "it is as if we go to an old inn by the sea and eat a pie or two of it at one"
    spaceless = "".join(chr(0x4E00 + 37 * i % 500) for i in range(80))
    lines = [small, small.replace("pie", "egg"), spaceless, spaceless[:40] + "\u5000" + spaceless[41:], "nothing like the other lines"]
    got = classes_of(spark, lines)
    assert got[0] == got[1] and got[2] == got[3] and len(set(got.values())) == 3


def test_near_copies_of_a_document_on_one_line(spark):
    """40,000 words, 20,000 of them distinct."""
    words = [f"word{i % 20_000}" for i in range(40_000)]
    other = [*words[:30_000], "something", "else", *words[30_000:]]
    got = classes_of(spark, [" ".join(words), " ".join(other)])
    assert got[0] == got[1]


def test_one_measure_at_every_length(spark):
    """Digits changed in every fourth word: 0.9 of the characters, 0.75 of the words stay alike."""
    for n in (150, 300):  # below and above 2,000 characters
        words = [f"number{i:04}" if i % 4 else f"{i % 10}{i:05}" for i in range(n)]
        other = [w if i % 4 else w[:1] + str((int(w[1]) + 1) % 10) + w[2:] for i, w in enumerate(words)]
        far = [w if i % 100 > 18 else "much longer than any" * 3 for i, w in enumerate(words)]
        lines = [" ".join(words), " ".join(other), " ".join(far)]
        assert (len(lines[0]) > 2_000) == (n == 300) and len(near_pairs(spark, lines)) == 1
        pairs = spark.createDataFrame([(0, 1), (0, 2)], "a bigint, b bigint")
        texts = spark.createDataFrame(list(enumerate(lines)), "node bigint, norm string")
        assert [(r.a, r.b) for r in fuzzy_lines._verify(pairs, texts, 0.8).collect()] == [(0, 1)]


def test_bounds_from_above_accept_no_pair_below_the_similarity(spark):
    rng = random.Random(5)
    words = ["a", "of", "tree", "house", "straße", "一丁", "\U0001f600x", "extraordinary"]
    rows = []
    for _ in range(400):
        left = [rng.choice(words) for _ in range(rng.randint(1, 30))]
        right = list(left)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(right) + 1)
            right[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 1))
        rows.append((" ".join(left), " ".join(right or ["a"])))
    pairs = spark.createDataFrame(rows, "l string, r string").withColumn("most", F.expr("cast(floor(0.2D * greatest(length(l), length(r)) + 1e-9D) as int)"))
    x, y, most = F.split("l", " ", -1), F.split("r", " ", -1), F.col("most")
    for bound in (fuzzy_lines._placewise, fuzzy_lines._wordwise):
        accepted = pairs.filter(bound(x, y, most)).selectExpr("l", "r", "levenshtein(l, r) <= most as near").collect()
        assert all(r.near for r in accepted) and any(r.l != r.r for r in accepted)


def test_links_without_neighbouring_words_in_common(spark):
    """A letter changed in every other word: no two neighbouring words stay, 0.9 of the characters do."""
    for n in (14, 60, 400):  # the last one is compared by words first
        words = [f"word{i:03}" for i in range(n)]
        other = ["x" + w[1:] if i % 2 else w for i, w in enumerate(words)]
        lines = [" ".join(words), " ".join(other), " ".join(reversed(words))]
        assert (0, 1) in near_pairs(spark, lines)
        pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a bigint, b bigint")
        texts = spark.createDataFrame(list(enumerate(lines)), "node bigint, norm string")
        got = fuzzy_lines._verify(pairs, texts, 0.8).collect()
        assert sorted((r.a, r.b) for r in got) == sorted(near_pairs(spark, lines))


def test_verified_pairs_are_those_of_the_distance(spark, monkeypatch):
    """Lines short and long, of which words were moved, dropped, repeated and changed."""
    monkeypatch.setattr(fuzzy_lines, "LONG", 60)
    rng = random.Random(6)
    words = ["a", "of", "tree", "house", "straße", "一丁", "\U0001f600x", "extraordinary"]
    lines = []
    for _ in range(25):
        left = [rng.choice(words) for _ in range(rng.randint(1, 25))]
        lines.append(left)
        for _ in range(3):
            at, to = sorted(rng.choices(range(len(left) + 1), k=2))
            right = rng.choice([left[to:] + left[:to], left[:at] + left[to:], left[:to] + left[at:], left + left[:1], left[1:], [*left[:at], "on", *left[at:]]])
            lines.append([w[:-1] if rng.random() < 0.1 and len(w) > 1 else w for w in right] or ["a"])
    lines = sorted({" ".join(x) for x in lines})
    pairs = spark.createDataFrame([(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines))], "a bigint, b bigint")
    texts = spark.createDataFrame(list(enumerate(lines)), "node bigint, norm string")
    want = near_pairs(spark, lines)
    assert sorted((r.a, r.b) for r in fuzzy_lines._verify(pairs, texts, 0.8).collect()) == sorted(want) and len(want) > 20


def test_every_sixth_word_replaced(spark):
    """Just above the similarity: SimHashes of 126 bits found 51 of these 100 pairs."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines, pairs = [], []
    for i in range(100):
        left = [word(rng.randint(2, 9)) for _ in range(60)]
        lines += [" ".join(left), " ".join(word(len(w)) if k % 6 == i % 6 else w for k, w in enumerate(left))]
        pairs.append((2 * i, 2 * i + 1))
    got = classes_of(spark, lines)
    found = sum(got[a] == got[b] for a, b in pairs)
    print(f"pairs {len(pairs)}, found {found}")
    assert found >= 95 and len(set(got.values())) == 200 - found


def test_unrelated_lines_share_few_keys(spark):
    """With frequent short words in common; keys of 16 bits bring pairs together by chance, with the square of the lines."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = [" ".join(word(8) if k % 2 else rng.choice(["the", "of", "and", "to", "in"]) for k in range(40)) for _ in range(4_000)]
    table = spark.createDataFrame(list(enumerate(lines)), "node bigint, norm string")
    members = fuzzy_lines.key_members(fuzzy_lines.line_hashes(table))
    assert members.count() == len(fuzzy_lines.key_lanes()) * len(lines)
    together = members.groupBy("bucket").count().selectExpr("sum(count * (count - 1) / 2) as pairs").first().pairs
    print(f"pairs in one bucket {together}")
    assert together < len(lines) / 4
