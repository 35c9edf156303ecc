"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case; of a run whose
crc32 of ``<doc_id>:<run>`` is divisible by 199 one code point is left out.  Words of at
least ``MIN_LENGTH`` code points that occur ``MIN_COUNT`` times or more are compared.

Two distinct words are one edit apart exactly if their common prefix and common suffix
together reach the longer length less one.  For a longer length m one of the two then
reaches m div 2, so every word stands, for m its own length and its own length plus one,
in a cell of its first and a cell of its last m div 2 code points.  Cells hash to
groups of about half a tile; a larger group is dealt into blocks and every pair of blocks
is a tile of its own, so no task gets more than two blocks of words.  A tile is two padded
matrices of code points, compared column by column from the front and from the back; it
returns, per word, how many near words it saw and the best of them.  A pair counts in the
prefix cell if its common prefix reaches m div 2, else in the suffix cell: exactly once.

Chains of forms are followed by pointer doubling: a form has five times its word's count,
so a chain has at most log5 of the largest count links.

Defined results: null text has no words; a null ``doc_id`` is empty in the digest that
picks the deletion; repeated rows count each; ties go to the smaller word in code-point
order; words and texts of any length are read whole; an empty table gives an empty
result.  Extra columns do not matter.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakguard.llm.shared import materialize, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LETTERS = r"[A-Za-zÀ-ÿ]"
DAMAGE = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
TILE = 512  # words of a block
_CODES = 1 << 22  # code points of a padded matrix
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEEN = "word string, n_near bigint, best_n bigint, best string"


def words(docs: DataFrame) -> DataFrame:
    """Words and how often they occur in all documents: word, n."""
    # a run shorter than a word cannot give one, so only longer runs are taken out
    runs = F.regexp_extract_all(text_or_empty("text"), F.lit(f"{LETTERS}{{{MIN_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DAMAGE == 0, less).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))


def _codes(texts: list[str], width: int, pad: int) -> np.ndarray:
    codes = np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width).copy()
    codes[codes == 0] = pad
    return codes


def _shared(left: list[str], right: list[str], width: int) -> np.ndarray:
    """Length of the common beginning of every pair."""
    a, b = _codes(left, width, 0), _codes(right, width, 0xFFFFFFFF)  # pads never agree
    alike = np.ones((len(left), len(right)), dtype=bool)
    length = np.zeros(alike.shape, dtype=np.int32)
    for i in range(width):
        alike &= a[:, i, None] == b[None, :, i]
        if not alike.any():
            break
        length += alike
    return length


def near_matrix(left: list[str], right: list[str], m: int, side: int) -> np.ndarray:
    """Which pairs of a cell for longer length ``m`` are one edit apart and belong to ``side``."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    step = max(1, _CODES // m)
    of = lambda texts: np.array([len(t) for t in texts])
    for i in range(0, len(left), step):
        for j in range(0, len(right), step):
            a, b = left[i : i + step], right[j : j + step]
            prefix = _shared(a, b, m)
            suffix = _shared([t[::-1] for t in a], [t[::-1] for t in b], m)
            near = (prefix + suffix >= m - 1) & (prefix < m)
            near &= (of(a)[:, None] == m) | (of(b)[None, :] == m)
            near &= prefix >= m // 2 if side == 0 else prefix < m // 2
            out[i : i + step, j : j + step] = near
    return out


def _best_first(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def _compare_tile(table: pa.Table) -> pa.Table:
    """Per word of a tile: near words seen, the most frequent of them and its count."""
    first = {c: table.column(c)[0].as_py() for c in ("m", "side", "low", "high")}
    rows = list(zip(*(table.column(c).to_pylist() for c in ("word", "n", "block")), strict=True))
    low = _best_first([(w, n) for w, n, b in rows if b == first["low"]])
    high = low if first["low"] == first["high"] else _best_first([(w, n) for w, n, b in rows if b == first["high"]])
    seen = []
    if low and high:
        near = near_matrix([w for w, _ in low], [w for w, _ in high], first["m"], first["side"])
        # the other side is sorted, so the first near word is the best
        passes = [(low, high, near)] + ([] if high is low else [(high, low, near.T)])
        for of, others, matrix in passes:
            count, at = matrix.sum(axis=1), matrix.argmax(axis=1)
            seen += [(of[i][0], int(count[i]), others[at[i]][1], others[at[i]][0]) for i in np.flatnonzero(count)]
    columns = list(zip(*seen, strict=True)) if seen else [[], [], [], []]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(counted: DataFrame) -> DataFrame:
    """Words with near words: word, n_near, best_n, best (of largest n, then smallest)."""
    length = F.length("word")
    stands = counted.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
    classes = stands.groupBy("m").agg(F.ceil(F.count("*") / F.lit(TILE // 2)).cast("long").alias("groups"))
    half = F.expr("m div 2").cast("int")
    cells = stands.join(classes, "m").select(
        "word", "n", "m", "groups",
        F.inline(F.array(
            F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), half).alias("part")),
            F.struct(F.lit(1).alias("side"), F.substr("word", length - half + 1, half).alias("part")),
        )),
    )
    cells = cells.select("word", "n", "m", "side", F.pmod(F.xxhash64("part"), F.col("groups")).alias("cell"))
    place = ["m", "side", "cell"]
    crowded = cells.groupBy(*place).agg(F.count("*").alias("size")).filter(F.col("size") > TILE)
    crowded = crowded.select(*place, F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    dealt = cells.join(crowded, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high")),
    )
    tiles = dealt.select("word", "n", *place, "block", F.inline(meets))
    seen = tiles.groupBy(*place, "low", "high").applyInArrow(_compare_tile, _SEEN)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    whole = seen.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return whole.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """The end of each chain of (word, form) links: word, root."""
    ends = materialize(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not ends.filter("moved").isEmpty():
        on = ends.select(F.col("word").alias("via"), F.col("root").alias("far"))
        far = ends.join(on, ends["root"] == on["via"], "left")
        ends = materialize(
            far.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots"
        )
    return ends.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = materialize(words(docs), "words")
    joined = counted.join(near_words(counted), "word", "left")
    good = F.col("best_n") >= F.lit(RATIO) * F.col("n")
    formed = materialize(
        joined.select(
            "word",
            F.when(good, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(good, F.col("best_n")).alias("form_n"),
        ),
        "formed",
    )
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
