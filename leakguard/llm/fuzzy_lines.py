"""Line deduplication with fuzzy matches (weighted minhashes, keys of four, edit distance).

Lines are normalised: lowered, runs of other characters than letters and digits become a
space.  A line has twenty minima over its words: each word's hash is divided by the square of
the word's length (up to ``_HEAVY``), so that long words are the smallest more often than short
and frequent ones.  ``BITS`` bits stay of each minimum.  A line is put under ``5 * CLASSES`` keys
of four minima each, no two of which have more than one minimum in common.  Two lines that share
a key and have at least ``MIN_ALIKE`` equal minima are candidates.  Lines of at most ``FEW_WORDS``
words get minima over their character 4-grams as well, so that one word, or a script without
spaces, is no obstacle.  Lines of at most ``SHORT`` characters also get what is left of them after
up to two deletions: no pair of at least 0.8 between two such lines is lost, since both come down
to the same text by at most a fifth of the longer.  No line is left out for its number of words
or characters.
Two candidates are linked if the edit similarity of the normalised lines is 0.8 or more,
which is decided exactly: bounds only accept, and only what the distance would accept too.
Of the occurrences in a connected group the first stays, by doc_id (null last), then row,
then place in the text.

Minima are chances: two lines whose words have the weighted Jaccard similarity j share one of
the keys with a chance of about 1 - (1 - j^4)^(5 * CLASSES), which is 0.96 for two thirds (a fifth of
the words replaced).  Measured recall is in the README.  A key has 24 bits, so chance brings few
lines together; those that share many long words meet however many lines there are.

Equal lines are one node, whatever their number, and no key emits all its pairs (see
``bucket_components``).  Only column expressions are used.  Texts are read once; normalised
lines are written, and compared later only for the lines that have candidates.

Defined results: null text is empty; lines without letters and digits stay and are not
counted as duplicates; the edit similarity counts characters at every length; repeated rows
are duplicates of each other line by line; an empty table gives an empty result.  Extra columns
of any name pass through ``dedup_lines``, which takes the order of the rows instead of doc_id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakguard.llm.components import bucket_components, crowded_buckets
from leakguard.llm.shared import fresh, materialize, shuffles_released, text_or_empty

SIMILARITY = 0.8
# Minima of a line's features, in two words of LANES numbers of BITS bits.
BITS = 6
LANES = 10
# Keys of four minima: CLASSES times five, no two of which have more than one minimum in common.
CLASSES = 3
MIN_ALIKE = 9
FEW_WORDS = 10
# Texts of more characters are compared with fewer edits allowed first.
LONG = 2_000
# A fifth of this many characters is at most two edits.
SHORT = 14
_GRAM = 4
# Words of more letters weigh as much as words of so many.
_HEAVY = 12
# The lowest bit of every lane.
_ONES = sum(1 << BITS * i for i in range(LANES))


def normalised(line: Column) -> Column:
    # a single space between words is no match, so only punctuation costs a replacement
    other = r"a-z0-9\p{L}\p{N}"
    return F.trim(F.regexp_replace(F.lower(line), rf"[^{other} ][^{other}]*+| [^{other}]++", " "))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, row, line_no, norm, node (null: no words)."""
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        F.monotonically_increasing_id().alias("row"),
        F.split(text_or_empty("text"), "\n", -1).alias("lines"),
    )
    lines = rows.select("doc_id", "row", F.posexplode("lines").alias("line_no", "line"))
    lines = lines.select("doc_id", "row", "line_no", normalised(F.col("line")).alias("norm"))
    return lines.withColumn("node", F.when(F.length("norm") > 0, F.xxhash64("norm")))


def line_hashes(lines: DataFrame) -> DataFrame:
    """Per distinct line of (node, norm) and kind of features: node, grams (else words), first, second (LANES minima each).

    Copies and repeated words change no minimum, so neither needs to be found first.
    """
    # every 4-gram is a whole one from one of four starts
    grams = F.concat(*(F.regexp_extract_all(F.substring("norm", i + 1, 2**31 - 1), F.lit(f".{{{_GRAM}}}"), 0) for i in range(_GRAM)))

    def hashed(few: DataFrame, is_grams: bool, features: Column) -> DataFrame:
        one = few.select("node", F.explode(features).alias("feature"))
        heavy = F.least(F.length("feature"), F.lit(_HEAVY))
        scale = F.floor(F.lit(_HEAVY**2 << 8) / (heavy * heavy))
        return one.select("node", F.lit(is_grams).alias("grams"), F.xxhash64("feature").alias("h"), scale.alias("scale"))

    def lanes(which: range) -> Column:
        bits = (F.shiftleft(F.xxhash64(f"m{i}").bitwiseAND(F.lit((1 << BITS) - 1)), BITS * at) for at, i in enumerate(which))
        return functools.reduce(Column.bitwiseOR, bits)

    def hashes(features: DataFrame) -> DataFrame:
        # a number over a weight is the smallest with a chance near to the share of that weight; each hash gives two
        halves = (F.shiftrightunsigned, lambda h, _: h.bitwiseAND(F.lit((1 << 32) - 1)))
        number = lambda i: halves[i % 2](F.xxhash64(F.col("h").bitwiseXOR(F.lit(i // 2))), 32) * F.col("scale")
        minima = features.groupBy("node", "grams").agg(*(F.min(number(i)).alias(f"m{i}") for i in range(2 * LANES)))
        return minima.select("node", "grams", lanes(range(LANES)).alias("first"), lanes(range(LANES, 2 * LANES)).alias("second"))

    few = lines.filter(F.substring_index("norm", " ", FEW_WORDS) == F.col("norm"))
    return hashes(hashed(lines, False, F.split("norm", " ", -1))).union(hashes(hashed(few, True, grams)))


def key_lanes() -> list[tuple[int, ...]]:
    """The four minima of each key: lines of different slopes on a grid of four by five."""
    return [tuple(5 * x + (c - slope * x) % 5 for x in range(4)) for slope in range(CLASSES) for c in range(5)]


def key_members(hashes: DataFrame) -> DataFrame:
    """(node, first, second, bucket) of every key."""

    def key(k: int, four: tuple[int, ...]) -> Column:
        lanes = sum(((1 << BITS) - 1) << BITS * i for i in four)
        low, high = lanes & (1 << BITS * LANES) - 1, lanes >> BITS * LANES
        kind = F.when(F.col("grams"), 2 * k + 1).otherwise(2 * k)
        # as many bits as the minima and the kinds of keys have, since all bits are shuffled
        return F.xxhash64(kind, F.col("first").bitwiseAND(F.lit(low)), F.col("second").bitwiseAND(F.lit(high))).bitwiseAND(F.lit((1 << 4 * BITS + 5) - 1))

    keys = F.array(*(key(k, four) for k, four in enumerate(key_lanes())))
    # in the order in which exploding leaves them, so that no projection tells the sides of the join apart
    return hashes.select("node", "first", "second", F.explode(keys).alias("bucket"))


def _minima_alike(x: str, y: str) -> str:
    """Whether ``MIN_ALIKE`` minima of two members are the same (members without minima: true)."""

    def apart(word: str) -> str:
        bits = f"({x}.{word} ^ {y}.{word})"
        folded = " | ".join(f"shiftrightunsigned({bits}, {i})" for i in range(BITS))
        return f"bit_count(({folded}) & {_ONES}L)"

    return f"coalesce({apart('first')} + {apart('second')} <= {2 * LANES - MIN_ALIKE}, true)"


def short_members(short: DataFrame) -> DataFrame:
    """(node, first, second, bucket), without minima, of distinct lines (node, short): one for each way to delete up to two characters."""
    without = lambda s: F.transform(
        F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(SHORT)))
    )
    n, none = F.length("short"), F.array().cast("array<string>")
    left = short.select("node", n.alias("n"), F.array("short").alias("whole"), F.when(n >= 4, without(F.col("short"))).otherwise(none).alias("one"))
    two = F.when(F.col("n") >= 8, F.flatten(F.transform("one", without))).otherwise(none)
    left = left.select("node", F.explode(F.array_distinct(F.concat("whole", "one", two))).alias("left"))
    none = F.lit(None).cast("bigint")
    return left.select("node", none.alias("first"), none.alias("second"), F.xxhash64(F.lit("short"), "left").alias("bucket"))


def _near(least: float) -> Callable[[str, str], str]:
    """Lengths that allow the similarity, and enough equal minima."""
    return lambda x, y: (
        f"abs({x}.n - {y}.n) <= floor({1 - least!r}D * greatest({x}.n, {y}.n) + 1e-9D) and {_minima_alike(x, y)}"
    )


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _differing(left: Column, right: Column) -> Column:
    """Both lists of words, as (left, right), from the first place where they differ, last word first."""
    place = F.array_position(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    rest = lambda words, at: F.reverse(F.slice(words, at, F.size(words)))
    return _once(F.greatest(place.cast("int"), F.lit(1)), lambda at: F.struct(rest(left, at).alias("left"), rest(right, at).alias("right")))


def _placewise(left: Column, right: Column, allowed: Column) -> Column:
    """Whether replacing words at their places takes few enough edits: a bound from above."""
    cost = F.zip_with(left, right, lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y))))
    return (F.size(left) == F.size(right)) & (F.aggregate(cost, F.lit(0), lambda s, x: s + x) <= allowed)


def _wordwise(left: Column, right: Column, allowed: Column) -> Column:
    """Whether few enough words are edited, each counted as the longest: a bound from above.

    A word is written as one character, by its hash, and the bound holds only if no two
    words of the pair share one.
    """
    code = lambda x: F.pmod(F.hash(x), F.lit(0xF0000)) + 0x10000
    spelt = lambda words: F.decode(
        F.unhex(F.array_join(F.transform(words, lambda x: F.lpad(F.hex(code(x)), 8, "0")), "")), "UTF-32"
    )
    words = F.array_distinct(F.concat(left, right))
    apart = F.size(F.array_distinct(F.transform(words, code))) == F.size(words)
    longest = F.aggregate(words, F.lit(0), lambda s, x: F.greatest(s, F.length(x)))
    edits = F.floor(allowed / (longest + 1)).cast("int")
    return apart & (F.call_function("levenshtein", spelt(left), spelt(right), edits) >= 0)


def _alike(left: Column, right: Column, allowed: Column) -> Column:
    """Whether two texts are ``allowed`` edits apart or fewer."""
    return F.call_function("levenshtein", left, right, allowed) >= 0


def _words_alike(left: Column, right: Column, allowed: Column) -> Column:
    """``_alike`` of lists of words.

    Words that both begin or end with are no edits.  Bounds from above settle most links
    between the others; the whole distance, whose time grows with the square of the length,
    is for the rest.
    """
    # a space after every word: what is cut off is a whole prefix and suffix of both
    spelt = lambda words: F.concat(F.array_join(words, " "), F.when(F.size(words) > 0, " ").otherwise(""))

    def within(t: Column) -> Column:
        x, y = t["left"], t["right"]
        longest = F.greatest(F.length(x), F.length(y))
        fewer = (longest > LONG) & _alike(x, y, F.floor(allowed / 16).cast("int"))
        return (longest <= allowed) | fewer | _alike(x, y, allowed)

    def settled(w: Column) -> Column:
        x, y = w["left"], w["right"]
        texts = F.struct(spelt(x).alias("left"), spelt(y).alias("right"))
        return _wordwise(x, y, allowed) | _once(texts, within)

    cut = _once(_differing(left, right), lambda w: _once(_differing(w["left"], w["right"]), settled))
    return _placewise(left, right, allowed) | cut


def _verify(pairs: DataFrame, texts: DataFrame, least: float, likely: bool = True) -> DataFrame:
    """Pairs (a, b) of at least the edit similarity: all of them, and no others.

    Where few pairs are ``likely`` to be links, bounds that only accept would come on top of
    the distance, so they are left to long texts.
    """
    both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
    longest = F.greatest(F.length("left"), F.length("right"))
    allowed = F.floor((1 - F.lit(least)) * longest + F.lit(1e-9)).cast("int")
    near = both.withColumn("allowed", allowed).filter(F.abs(F.length("left") - F.length("right")) <= F.col("allowed"))
    words = (F.split(c, " ", -1) for c in ("left", "right"))
    alike = _words_alike(*words, F.col("allowed"))
    if not likely:
        whole = _alike(F.col("left"), F.col("right"), F.col("allowed"))
        alike = F.when(F.greatest(F.length("left"), F.length("right")) <= LONG, whole).otherwise(alike)
    return near.filter(alike).select("a", "b")


def _with_partner(members: DataFrame) -> DataFrame:
    """Members that another one of their bucket is near to; both sides are one exchange.

    A partition's members are hashed, which takes half of the time of sorting them on both sides.
    """
    met = F.expr(f"x.bucket = y.bucket and x.node <> y.node and {_minima_alike('x', 'y')}")
    return members.alias("x").join(members.alias("y").hint("shuffle_hash"), met, "left_semi").select("bucket", "node", "first", "second")


def _distinct(lines: DataFrame) -> DataFrame:
    """(node, norm) of lines; any of the equal lines, so the smallest is the line."""
    return lines.groupBy("node").agg(F.min("norm").alias("norm"))


def _labelled(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """One row per line (doc_id, row, line_no, place, class_id) and per class of several lines (class_id, first)."""
    lines = materialize(line_table(docs), "lines", "zstd")
    worded = lines.filter("node is not null")
    hashes = materialize(line_hashes(worded), "line-hashes")
    short = _distinct(worded.filter(F.length("norm") <= SHORT)).select("node", F.col("norm").alias("short"))
    # members that have a partner; a member comes out once, however many it has
    paired = materialize(_with_partner(key_members(hashes)).union(_with_partner(short_members(short))), "paired")
    wanted = paired.select("node").distinct()
    texts = materialize(_distinct(worded.join(wanted, "node", "left_semi")), "line-texts", "zstd")
    paired = paired.join(texts.select("node", F.length("norm").alias("n")), "node")
    paired = paired.select("bucket", "node", F.struct("n", "first", "second").alias("trait"))
    verify = functools.partial(_verify, texts=texts, least=least)
    strays = functools.partial(verify, likely=False)
    labels = bucket_components(crowded_buckets(paired), _near(least), verify, verify_strays=strays)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "line_no")
    placed = lines.drop("norm").join(labels, "node", "left").withColumn("place", place)
    placed = placed.select("doc_id", "row", "line_no", "place", F.coalesce("label", "node").alias("class_id"))
    first = placed.filter("class_id is not null").groupBy("class_id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return placed, first.filter("n > 1").drop("n")


def line_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per line: doc_id, row, line_no, class_id (null: no words), kept."""
    with shuffles_released(docs.sparkSession):
        placed, first = _labelled(docs, least)
    return placed.join(first, "class_id", "left").select(
        "doc_id", "row", "line_no", "class_id", F.coalesce(F.col("place") == F.col("first"), F.lit(True)).alias("kept")
    )


def line_report(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_lines, n_kept, dropped (line numbers from 0, joined)."""
    with shuffles_released(docs.sparkSession):
        placed, first = _labelled(docs, least)
    gone = placed.join(first, "class_id").filter(F.col("place") != F.col("first")).groupBy("row")
    gone = gone.agg(F.count("*").alias("n_gone"), F.array_join(F.sort_array(F.collect_list("line_no")), ",").alias("dropped"))
    return (
        placed.groupBy("row", "doc_id")
        .agg(F.count("*").alias("n_lines"))
        .join(gone, "row", "left")
        .select(
            "doc_id",
            "n_lines",
            (F.col("n_lines") - F.coalesce("n_gone", F.lit(0))).alias("n_kept"),
            F.coalesce("dropped", F.lit("")).alias("dropped"),
        )
    )


def dedup_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` whose texts have lost the lines that do not stay.

    Rows are numbered in a written copy of the table, so that decisions meet the row
    they were made for even where doc_ids repeat.
    """
    number, gone, of = fresh(docs, "number", "gone", "of")
    named = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "line-docs")
    # the row number stands in for the id, so the first row of equal ids comes first
    numbered = named.select(F.col(number).alias("doc_id"), "text")
    lost = line_classes(numbered, least).filter("not kept").groupBy(F.col("doc_id").alias(of))
    lost = lost.agg(F.collect_set("line_no").alias(gone))
    joined = named.join(lost, named[number] == lost[of], "left")
    kept = F.filter(F.split(text_or_empty("text"), "\n", -1), lambda _, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*docs.columns)
