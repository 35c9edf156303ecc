"""URL filter: rules first, then boosted trees over lexical features.

A rule is a host and the beginning of a path, such as ``example.net/en/``; it fits its host
and all subdomains.  The longest rule that fits decides (of equally long ones the first in
order of text).  URLs that no rule decides are judged by gradient-boosted trees trained on
the URLs that rules label.  Features are lexical only: lengths, depth, share of digits,
entropy of the characters, number of parameters, and statistics of suffixes: of the last
host label, the last two and the file ending, how often labelled URLs have them and which
share of those is blocked.  The statistics count all labelled URLs; a labelled URL is
given those of the folds it is not in, so that its own label does not leak into them.

The trees are fitted on a bounded sample, ``MAX_TRAINING`` URLs of each verdict, the first
in the order of a hash; every URL is scored.  Rules are few enough to be written into the
plan (a condition each), so no row is shuffled for them.  Suffixes are few and joined after
a pre-aggregation.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is scored as an empty text; URLs of any length are read whole; repeated rows and
ties are judged alike, each as a row of its own; a null ``page_id`` is kept; an empty table
gives an empty result; when the rules label no URL, or all alike, there is nothing to
learn and the rest gets the one verdict seen (``allow`` without any).  Extra columns do
not matter.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass
from math import log2

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakguard.llm.shared import materialize, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
# Bounds of the sample that the trees are fitted on, for each verdict.
MAX_TRAINING = 10_000
ROUNDS, DEPTH = 12, 4
FOLDS = 5
PRIOR = 5.0  # labelled URLs that a suffix's share of blocked ones is drawn to the mean by
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SUFFIXES = ("top", "site", "ending")


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url (null: empty), host, path, query."""
    rows = pages.select("page_id", text_or_empty("url").alias("url"))
    at = F.instr("url", "://")
    rows = rows.withColumn("_rest", F.when(at > 0, F.substr("url", at + 3)).otherwise(F.lit("")))
    rows = rows.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    rows = rows.withColumn("_rest", F.substr("_rest", F.length("_host") + 1))
    return rows.select(
        "page_id",
        "url",
        F.translate("_host", _UPPER, _LOWER).alias("host"),
        F.regexp_extract("_rest", "^[^?#]*", 0).alias("path"),
        F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
    return host & F.startswith(F.col("path"), F.lit(rule.path))


def with_rules(parts: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` and ``ruled`` (its verdict), both null where none fits."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    # from the weakest to the strongest, each put before the others
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        rule = F.when(_fits(r), F.lit(r.text)).otherwise(rule)
        ruled = F.when(_fits(r), F.lit(r.verdict)).otherwise(ruled)
    return parts.withColumns({"rule": rule, "ruled": ruled})


def _entropy(urls: pd.Series) -> pd.Series:
    """Bits a character of each text."""

    def bits(text: str) -> float:
        n = len(text)
        # in order of size, so that equal texts always add up to the same number
        return -sum(c / n * log2(c / n) for c in sorted(Counter(text).values()))

    return urls.map(bits).astype("float64")


def _lexical(rows: DataFrame) -> DataFrame:
    url, host, path, query = (F.col(c) for c in ("url", "host", "path", "query"))
    share = lambda c, pattern: (
        F.length(F.regexp_replace(c, pattern, "")) / F.greatest(F.length(c), F.lit(1))
    )
    values = {
        "f_length": F.length(url),
        "f_host": F.length(host),
        "f_path": F.length(path),
        "f_depth": F.size(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/+")),
        "f_labels": F.size(F.split(host, "[.]")),
        "f_longest": F.array_max(F.transform(F.split(host, "[.-]"), F.length)),
        "f_dashes": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "f_digits": share(url, "[^0-9]"),
        "f_host_digits": share(host, "[^0-9]"),
        "f_vowels": share(host, "[^aeiou]"),
        "f_entropy": F.pandas_udf(_entropy, "double")(url),
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "f_fragment": F.contains(url, F.lit("#")).cast("int"),
        "f_secure": F.startswith(url, F.lit("https:")).cast("int"),
    }
    values = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()}
    suffixes = {
        "top": F.regexp_extract(host, "[^.]*$", 0),
        "site": F.regexp_extract(host, "[^.]*[.]?[^.]*$", 0),
        "ending": F.regexp_extract(path, "[.]([A-Za-z0-9]{1,8})$", 1),
    }
    return rows.withColumns(values | suffixes)


def _with_suffixes(rows: DataFrame) -> DataFrame:
    """Add count and share of blocked URLs of each suffix among the labelled ones."""
    known = rows.filter("ruled is not null").withColumn("blocked", (F.col("ruled") == "block").cast("long"))
    mean = known.agg((F.sum("blocked") / F.count("*")).alias("mean")).first()["mean"] or 0.0
    for suffix in _SUFFIXES:
        folds = known.groupBy(suffix, "fold").agg(F.count("*").alias("_n"), F.sum("blocked").alias("_b"))
        own = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("_n", "_b"))))  # at most FOLDS entries
        stats = folds.groupBy(suffix).agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"), own.alias("_own"))
        rows = rows.join(stats, suffix, "left")
        less = lambda name: F.coalesce(F.col(name), F.lit(0)) - F.when(
            F.col("ruled").isNotNull(), F.col("_own")[F.col("fold")][name]
        ).otherwise(0)
        rows = rows.withColumn("_left", less("_n")).withColumn("_bad", less("_b"))
        rows = rows.withColumns(
            {
                f"f_{suffix}_seen": F.log1p(F.col("_left").cast("double")),
                f"f_{suffix}_share": (F.col("_bad") + PRIOR * mean) / (F.col("_left") + PRIOR),
            }
        ).drop("_n", "_b", "_own", "_left", "_bad")
    return rows


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (how likely the trees find ``block``)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = with_rules(with_parts(pages), rules).withColumn("order", F.xxhash64("url", "page_id"))
    rows = _lexical(rows.withColumn("fold", F.pmod("order", F.lit(FOLDS)))).drop("url", "query")
    rows = materialize(_with_suffixes(materialize(rows, "url-parts")), "url-features")
    names = [c for c in rows.columns if c.startswith("f_")]
    picks = []
    for verdict in ("block", "allow"):
        of = rows.filter(F.col("ruled") == verdict).select("ruled", "order", "page_id", *names)
        picks.append(of.orderBy("order", "page_id").limit(MAX_TRAINING))
    sample = picks[0].union(picks[1]).withColumn("label", (F.col("ruled") == "block").cast("double"))
    sample = materialize(sample, "url-sample")
    seen = {r["ruled"] for r in sample.select("ruled").distinct().collect()}
    if len(seen) < 2:
        scored = rows.withColumn("score", F.lit(1.0 if seen == {"block"} else 0.0))
    else:
        vector = VectorAssembler(inputCols=names, outputCol="features")
        model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=12).fit(vector.transform(sample))
        scored = model.transform(vector.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
