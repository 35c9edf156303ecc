"""Personal data in texts: proposed spans, boosted trees, calibrated thresholds.

Generators with high recall propose spans of four kinds (email, ip, card, phone).  The
base spans, those that pass their kind's exact check, always stay.  Other proposals
(spelled-out addresses, national phone numbers, long ip forms, and base proposals that
fail a check) are scored by gradient-boosted trees over format and context features.
The trees learn from base spans (positive) and failed proposals (negative), from two
thirds of all there are; the features leave out the checks themselves.  A threshold per
kind is calibrated on all of the other third so that at least ``PRECISION`` of what it
selects there is right; it is a step of ``STEPS`` between 0 and 1.  Nothing is sampled here;
Spark's learner takes the values at which a tree may split from some 10,000 training rows,
and decides between them by counting all.  Selected spans that overlap a base span or a better
selected span are left out.

Everything is column expressions and Spark's own learner: one scan proposes all spans,
and only proposals go on.  The patterns use possessive repetition and start only where a
match can start, so they take linear time and no stack on long runs of digits or letters;
they find the same matches as the plain forms.

Defined results: null text is empty; a text without spans gives zero counts, the digest
of the empty string and empty ``spans``; repeated rows are scored each on its own; a null
``doc_id`` is kept; an empty table gives an empty result; without both positive and
failed proposals no span is added to the base ones.  Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakguard.llm.shared import fresh, materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
STEPS = 4_096  # of a score between 0 and 1, when thresholds are counted
MIN_SUPPORT = 20  # proposals above a threshold when it is calibrated
ROUNDS, DEPTH = 8, 3

_LOCAL = "A-Za-z0-9._%+-"
_PART = "[A-Za-z0-9-]++"
_AT = r"(?: ?\[at\] ?| ?\(at\) ?| ?\{at\} ?| at )"
_DOT = r"(?: ?\[dot\] ?| ?\(dot\) ?| ?\{dot\} ?| dot |\.)"
# name, kind, pattern, condition that a text with a match fulfils, base or not
GENERATORS = (
    ("email", "email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_PART}(?:\.{_PART})++", "contains(text, '@')"),
    ("ip", "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "text rlike '[0-9][.][0-9]'"),
    ("card", "card", r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+", "digit"),
    ("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')"),
    ("spelled", "email", rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}{_PART}(?:{_DOT}{_PART})++", r"text rlike '[\\[({ ]at[\\])} ]' and (contains(text, 'dot') or text rlike '[\\[({]at[\\])}]')"),
    ("national", "phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){2,4}(?![0-9A-Za-z.-])", "digit"),
    ("ip6", "ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "contains(text, ':')"),
    ("split_ip", "ip", r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)| dot )[0-9]{1,3}+){3}(?![0-9])", "digit"),
)
_BASE = {"email", "ip", "card", "phone"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CUES = {
    "phone": "(?i)(?:tel|phone|call|mobile|fax|cell)",
    "mail": "(?i)(?:mail|contact|write)",
    "card": "(?i)(?:card|visa|credit|account|pay)",
    "net": "(?i)(?:ip|host|addr|server|from)",
    "secret": "(?i)(?:token|key|passw|secret|version|license|=|#)",
}


def _proposals(text: Column, name: str, pattern: str, condition: str) -> Column:
    """Array of (generator, n, gap, found, before, after) of one generator."""
    when = F.col("digit") if condition == "digit" else F.expr(condition)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def one(i: Column) -> Column:
        return F.struct(
            F.lit(name).alias("generator"),
            i.alias("n"),
            F.length(F.get(gaps, i)).alias("gap"),
            F.get(found, i).alias("found"),
            F.right(F.get(gaps, i), F.lit(24)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"),
        )

    some = F.transform(F.sequence(F.lit(0), F.size(found) - 1), one)
    return F.when(when & F.expr("text").rlike(pattern), some)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def propose(docs: DataFrame) -> DataFrame:
    """One row per proposal, and one (without generator) for a text that has none."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), text_or_empty("text").alias("text")
    )
    rows = rows.withColumn("digit", text.rlike("[0-9]"))
    arrays = [F.coalesce(_proposals(text, n, p, c), F.array()) for n, _, p, c in GENERATORS]
    wanted = F.col("digit") | F.contains(text, F.lit("@")) | F.contains(text, F.lit("at")) | F.contains(text, F.lit(":"))
    listed = rows.select("doc_id", "row", F.when(wanted, F.concat(*arrays)).alias("all"))
    found = listed.select("doc_id", "row", F.explode_outer("all").alias("p")).select("doc_id", "row", "p.*")
    found = materialize(found, "proposals")
    before = Window.partitionBy("row", "generator").orderBy("n")
    size = F.length("found")
    end = F.sum(F.col("gap") + size).over(before)
    kind = F.create_map(*(F.lit(x) for g in GENERATORS for x in g[:2]))
    digits = F.regexp_replace("found", "[^0-9]", "")
    n = F.length(digits)
    spans = (
        found.filter("generator is not null")
        .withColumns({"end": end, "kind": kind[F.col("generator")], "digits": digits, "n_digits": n})
        .withColumn("start", F.col("end") - size)
    )
    valid = (
        F.when(F.col("generator") == "email", F.lit(True))
        .when(F.col("generator") == "ip", F.col("found").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(F.col("generator") == "card", F.when(F.col("n_digits").between(14, 19), luhn(F.col("digits"))).otherwise(False))
        .when(F.col("generator") == "phone", F.col("n_digits").between(10, 15))
    )
    return found.filter("generator is null").select("doc_id", "row"), spans.withColumn("valid", valid)


def _features(spans: DataFrame) -> DataFrame:
    """Format and context of each proposal, without what the checks test."""
    found, before, after = F.col("found"), F.col("before"), F.col("after")
    share = lambda pattern: (F.length(found) - F.length(F.regexp_replace(found, pattern, ""))) / F.length(found)
    values = {
        "f_length": F.least(F.length(found), F.lit(80)),
        "f_digits": F.least(F.col("n_digits"), F.lit(40)),
        "f_digit_share": share("[0-9]"),
        "f_letter_share": share("[A-Za-z]"),
        "f_hex_share": share("[A-Fa-f]"),
        "f_spaces": share(" "),
        "f_dots": share("[.]"),
        "f_dashes": share("-"),
        "f_at": found.rlike(r"@|\[at\]|\(at\)|\{at\}| at ").cast("int"),
        "f_plus": found.startswith("+").cast("int"),
        "f_brackets": found.rlike(r"[()\[\]]").cast("int"),
        "f_groups": F.least(F.size(F.split(found, "[^0-9A-Za-z]+")), F.lit(20)),
        "f_first_group": F.length(F.regexp_extract(found, "^[^0-9]*([0-9]*)", 1)).cast("int"),
        "f_glued_before": before.rlike(r"[\w=\"']$").cast("int"),
        "f_glued_after": after.rlike(r"^[\w\"'=]").cast("int"),
        "f_edge": ((F.length(before) == 0) | (F.length(after) == 0)).cast("int"),
        **{f"f_cue_{k}": before.rlike(p).cast("int") for k, p in _CUES.items()},
    }
    return spans.withColumns({k: v.cast("double") for k, v in values.items()})


def _thresholds(scored: DataFrame) -> dict[str, int]:
    """Per kind the lowest step of the score from which on the calibration rows reach the precision.

    ``scored`` has kind, step and label of every row; they are counted by kind and step, so
    that at most ``STEPS + 1`` rows of a kind reach the driver.  A kind without enough rows
    gets the threshold of all kinds together.
    """
    counted = scored.groupBy("kind", "step").agg(F.count("*").alias("n"), F.sum("label").alias("right"))
    rows = [(r["kind"], r["step"], r["n"], r["right"]) for r in counted.collect()]

    def lowest(part: list[tuple[str, int, int, float]]) -> int | None:
        by_step: dict[int, tuple[int, float]] = {}
        for _, step, n, right in part:
            before = by_step.get(step, (0, 0.0))
            by_step[step] = (before[0] + n, before[1] + right)
        selected, good, found = 0, 0.0, None
        for step in sorted(by_step, reverse=True):
            selected, good = selected + by_step[step][0], good + by_step[step][1]
            if selected >= MIN_SUPPORT and good >= PRECISION * selected:
                found = step
        return found

    together = lowest(rows)
    out = {}
    for kind in KINDS:
        own = lowest([r for r in rows if r[0] == kind])
        best = max([x for x in (own, together, STEPS // 2) if x is not None])
        out[kind] = best if own is not None or together is not None else 2 * STEPS
    return out


def added_spans(spans: DataFrame) -> DataFrame | None:
    """Spans beyond the base ones that the calibrated trees select, before overlaps."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    featured = _features(spans)
    names = [c for c in featured.columns if c.startswith("f_")]
    vector = VectorAssembler(inputCols=names, outputCol="features")
    # the part goes by what a proposal is, so that it is the same in every order of the rows
    part = F.pmod(F.xxhash64("doc_id", "generator", "start", "found"), F.lit(3))
    known = featured.filter("valid is not null").select("kind", F.col("valid").cast("double").alias("label"), part.alias("part"), *names)
    known = materialize(known, "pii-known")
    train = known.filter("part <> 0")
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(vector.transform(train))
    score = vector_to_array("probability")[1]
    step = F.floor(score * STEPS).cast("int")
    held = vector.transform(known.filter("part = 0"))
    limits = _thresholds(model.transform(held).select("kind", step.alias("step"), "label"))
    least = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("kind")]
    rest = vector.transform(featured.filter("coalesce(valid, false) = false"))
    chosen = model.transform(rest).withColumn("score", score).filter(step >= least)
    return chosen.select("doc_id", "row", "kind", "start", "end", "score")


def find_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, row, base and all spans as sorted arrays of (start, kind number, end)."""
    bare, proposals = propose(docs)
    spans = materialize(proposals, "pii-spans")
    base = spans.filter("valid").select("doc_id", "row", "kind", "start", "end", F.lit(2.0).alias("score"))
    extra = added_spans(spans)
    both = base if extra is None else base.union(extra)
    # a run of spans each of which starts before an earlier one has ended
    by_place = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum((F.col("start") >= F.coalesce(reached, F.lit(-1))).cast("int")).over(by_place)
    rank = F.row_number().over(Window.partitionBy("row", "run").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start"))
    top = F.max("score").over(Window.partitionBy("row", "run"))
    both = both.withColumn("run", run).withColumns({"rank": rank, "top": top})
    both = both.filter("score = 2.0 or (rank = 1 and top < 2.0)")
    number = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))[F.col("kind")]
    one = F.struct(F.col("start").alias("start"), number.alias("kind"), F.col("end").alias("end"))
    listed = both.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("score") == 2.0, one))).alias("base"),
        F.sort_array(F.collect_list(one)).alias("spans"),
    )
    rows = bare.union(spans.select("doc_id", "row").distinct())
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    return rows.join(listed, "row", "left").select(
        "doc_id", "row", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base spans by kind, base_sha256, spans."""
    found = find_spans(docs)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, spans: DataFrame, mark: str = "[%s]") -> DataFrame:
    """``docs`` whose texts have each span (doc_id, spans) replaced by its kind's mark."""
    of, listed = fresh(docs, "of", "listed")
    found = spans.select(F.col("doc_id").alias(of), F.col("spans").alias(listed)).dropDuplicates([of])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[of]), "left")
    text = text_or_empty("text")
    names = F.array(*(F.lit(mark % k) for k in KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def put(state: Column, s: Column) -> Column:
        keep = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        return F.struct(F.concat(state["out"], keep, F.get(names, s["kind"])).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    def end(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    spans_or_none = F.coalesce(listed, F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    return joined.withColumn("text", F.aggregate(spans_or_none, start, put, end)).select(*docs.columns)
