"""Toxicity scores by weak supervision.

1. Features (words and word beginnings) are counted over a bounded sample of labelled
   documents outside the held-out fold; the most telling ones become the vocabulary.
2. Voters judge the sample: fixed word lists, lists induced from the vocabulary, and
   patterns; each says toxic, clean or nothing.
3. A generative label model estimates the voters' accuracies and their correlations and
   gives each row a posterior label.
4. A linear classifier is trained on the posterior labels; it scores every whole text.

Only the text enters a score.  The sample is at most ``MAX_TOXIC`` + ``MAX_CLEAN`` rows,
chosen by hash, whatever the size of the tables; its ids are broadcast under that bound.

Defined results: a null or empty text gets the score of a text without features; rows
with a null ``doc_id`` are scored and not held out; labels that are null or contradict
each other within a document count as toxic if any says so, null ones are left out;
without labelled rows only the fixed word lists count.  An empty table gives an empty
result.  Extra columns pass through.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakguard.llm import toxicity_kernel as kernel
from leakguard.llm import worker
from leakguard.llm.shared import fresh, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(kernel)
cloudpickle.register_pickle_by_value(worker)

# Bounds of the training sample and of the vocabulary.
MAX_TOXIC = 3_000
MAX_CLEAN = 5_000
MAX_FEATURES = 6_000
MIN_TOXIC_DOCS = 3
# An induced list takes features that this share of toxic documents has at least.
LISTED_SHARE = 0.01
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float
    listed: frozenset[int]
    voters: dict


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, share): the bounded sample; share: labelled rows a row stands for."""
    usable = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(fold(F.col("doc_id")) != HELD_OUT)
        .withColumn("order", F.xxhash64("doc_id"))
    )
    parts = []
    for toxic, bound in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        of = usable.filter(F.col("toxic") == toxic)
        count = of.count()
        share = max(1.0, count / bound)
        parts.append(of.orderBy("order", "doc_id").limit(bound).select("doc_id", "toxic", F.lit(share).alias("share")))
    sample = parts[0].union(parts[1])
    text = text_or_empty("text").alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").select("text", "toxic", "share")
    # a text copied many times must not make its words telling
    sketched = rows.mapInArrow(_sketch_task, "text string, toxic int, share double, sketch bigint")
    return sketched.dropDuplicates(["sketch", "toxic"]).drop("sketch")


def _sketch_task(batches):
    worker.release()
    for batch in batches:
        sketches = [kernel.sketch(t) for t in batch.column(0).to_pylist()]
        yield batch.append_column("sketch", pa.array(sketches, pa.int64()))


def _count_task(batches):
    for batch in batches:
        toxic, clean = kernel.count_features(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([toxic[f] for f in names], pa.int64()),
                pa.array([clean[f] for f in names], pa.int64()),
            ],
            ["feature", "toxic", "clean"],
        )


def _vote_task(vocabulary: dict[str, int], voter_of: np.ndarray, listed: frozenset[int]):
    def vote(batches):
        featurize = kernel.Featurizer(vocabulary, listed)
        for batch in batches:
            hits, votes = [], []
            for text in batch.column(0).to_pylist():
                own = featurize(text)
                hits.append(sorted(own))
                votes.append(bytes(kernel.votes(text, own, voter_of)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hits, pa.list_(pa.int32())), pa.array(votes, pa.binary()), batch.column(1), batch.column(2)],
                ["hits", "votes", "toxic", "share"],
            )

    return vote


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    rows = training_rows(docs, labels.select("doc_id", F.col("toxic").cast("int")))
    totals = rows.groupBy("toxic").count().collect()  # at most two rows
    n = {r["toxic"]: r["count"] for r in totals}
    odds = F.log(((F.col("t") + 0.5) / (n.get(1, 0) + 1)) / ((F.col("c") + 0.5) / (n.get(0, 0) + 1)))
    counts = rows.mapInArrow(_count_task, "feature string, toxic bigint, clean bigint")
    telling = (
        counts.groupBy("feature")
        .agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .filter(F.col("t") >= MIN_TOXIC_DOCS)
        .withColumn("odds", odds)
        .filter("odds > 1.5")
        .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "feature")
        .limit(MAX_FEATURES)
        .collect()
    )
    fixed = sorted(kernel._OF_LEXICON)
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys([*fixed, *(r["feature"] for r in telling), *kernel.SEVERAL]))}
    voter_of = np.full(len(vocabulary), -1)
    for r in telling:
        if r["t"] >= max(5, LISTED_SHARE * n.get(1, 0)) and r["c"] <= 0.02 * r["t"]:
            voter_of[vocabulary[r["feature"]]] = kernel.induced_voter(r["feature"])
    listed = frozenset({*(vocabulary[f] for f in fixed), *np.flatnonzero(voter_of >= 0).tolist()})
    judged = rows.mapInArrow(
        _vote_task(vocabulary, voter_of, listed), "hits array<int>, votes binary, toxic int, share double"
    ).toArrow()  # at most MAX_TOXIC + MAX_CLEAN rows
    if judged.num_rows == 0:
        weights = np.array([1.5 if f in kernel._OF_LEXICON else 0.0 for f in vocabulary])
        return ToxicityModel(vocabulary, weights, -2.0, listed, {})
    votes = np.frombuffer(b"".join(judged.column("votes").to_pylist()), np.uint8).reshape(judged.num_rows, -1)
    gold, share = judged.column("toxic").to_numpy(), judged.column("share").to_numpy()
    posterior, voters = kernel.label_model(votes, gold, share)
    hits = judged.column("hits").combine_chunks()
    lengths = hits.value_lengths().to_numpy(zero_copy_only=False)
    where = np.repeat(np.arange(judged.num_rows), lengths)
    weights, bias = kernel.logistic(where, hits.flatten().to_numpy(), judged.num_rows, len(vocabulary), posterior, share)
    return ToxicityModel(vocabulary, weights, bias, listed, voters)


def _score_task(vocabulary: dict[str, int], weights: np.ndarray, bias: float, listed: frozenset[int], at: int, name: str):
    def score(batches):
        featurize = kernel.Featurizer(vocabulary, listed)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(at)):
                z = bias + sum(weights[h] for h in featurize(text.as_py() or ""))
                out[i] = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))
            yield batch.append_column(name, pa.array(out))

    return score


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with a last column, the score from 0 to 1 (``toxicity`` if that name is free)."""
    name = fresh(docs, "toxicity")[0]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score_task(model.vocabulary, model.weights, model.bias, model.listed, docs.columns.index("text"), name), schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns."""
    name = fresh(docs, "toxicity")[0]
    return score(docs, fit(docs, labels)).filter(F.col(name) < THRESHOLD).drop(name)
