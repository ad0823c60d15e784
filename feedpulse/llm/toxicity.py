"""Toxicity by weak supervision.

Voters: lexicon entries (words) and patterns (word beginnings, shouting, runs of exclamation
marks) that vote "toxic" or abstain.  Entries are mined from the labelled training rows: those that
occur far more often in toxic texts than in others.

Label model: a generative model of the votes.  For each voter it estimates how often it
fires on toxic and on other texts, by expectation-maximisation over the votes of all
documents, started from the labelled rows; and how voters depend on each other, from their
joint votes within each class.  A voter counts for less the more it repeats others.

Classifier: a logistic regression over words and word beginnings, trained on the label
model's posteriors of the training sample, not on the labels themselves.  Its odds are then
calibrated on the sample's labels (two numbers), weighted to the share of toxic rows, so
that a score is a probability and 0.5 a fair cut.

Labels are read only of rows whose crc32(id) mod 5 is not 0.  The sample that entries are mined
from and the classifier is fitted on has at most ``SAMPLE_PER_CLASS`` rows of each label,
taken by a hash of the id; votes, label model and scores cover all documents.

Defined cases: a null or empty text has no words; its score is the classifier's base rate;
rows that repeat an id are scored each on its text; with no labelled row of one class, or
an empty table, every score is the base rate (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, written
from .words import ALNUM_SPLIT, Words, chunks, mix, prefix_hashes, signed

SAMPLE_PER_CLASS = 6000
VOTERS, FEATURES = 192, 4096
PREFIXES = (4, 5, 6)
MIN_SUPPORT, MIN_RATIO = 5, 8.0
EM_ROUNDS = 4
REGULARISATION = 1e-3
SHOUT_SHARE, MARKS = 0.4, 3  # patterns: share of capitals; exclamation marks in a row


def is_held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def features_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, feature)``: hashes of words and of word beginnings."""
    doc = words.doc
    hashes = [mix(words.hash ^ np.uint64(0x632BE59BD9B4E019))]
    docs = [doc]
    length = words.end - words.start
    for k, h in zip(PREFIXES, prefix_hashes(words, PREFIXES, lower=True)):
        longer = length > k
        hashes.append(mix(h[longer] ^ np.uint64(k)))
        docs.append(doc[longer])
    doc, feature = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


def _found(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, place in known)`` for the features that are in the sorted array ``known``."""
    doc, feature = features_of(words)
    if not len(known):
        return doc[:0], doc[:0]
    at = np.minimum(np.searchsorted(known, feature), len(known) - 1)
    hit = known[at] == feature
    return doc[hit], at[hit]


def _patterns(words: Words, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text: whether each pattern fires."""
    data = words.data
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    upper = np.bincount(text[(data >= 65) & (data <= 90)], minlength=len(offsets) - 1)
    lower = np.bincount(text[(data >= 97) & (data <= 122)], minlength=len(offsets) - 1)
    mark = data == ord("!")
    run = np.zeros(len(data), dtype=bool)
    if len(data) >= MARKS:
        run[MARKS - 1:] = np.logical_and.reduce([mark[k:len(data) - MARKS + 1 + k] for k in range(MARKS)])
    return [upper > SHOUT_SHARE * np.maximum(upper + lower, 1), np.bincount(text[run], minlength=len(offsets) - 1) > 0]


N_PATTERNS = 2


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in chunks(batch, "text", ALNUM_SPLIT, lower=True):
            doc, feature = features_of(words)
            toxic = part.column("toxic").to_numpy().astype(np.int64)[doc]
            names, at = np.unique(feature, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(names)), pa.array(np.bincount(at, weights=toxic, minlength=len(names)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(names)))],
                names=["feature", "toxic", "n"])


def _vote(known: np.ndarray):
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in chunks(batch, "text", ALNUM_SPLIT, lower=True):
                n = part.num_rows
                fired = np.zeros((n, len(known) + N_PATTERNS), dtype=bool)
                fired[_found(words, known)] = True
                lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in part.column("text")])
                for k, pattern in enumerate(_patterns(words, np.concatenate([[0], np.cumsum(lengths)]))):
                    fired[:, len(known) + k] = pattern
                votes = [np.flatnonzero(row).astype(np.int32) for row in fired]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(votes, pa.list_(pa.int32()))],
                                                 names=["id", "label", "votes"])
    return vote


def _matrix(votes: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(votes), width))
    flat = votes.flatten().to_numpy()
    size = np.diff(votes.offsets.to_numpy())
    out[np.repeat(np.arange(len(votes)), size), flat] = 1
    return out


class LabelModel:
    """Firing rates of the voters on toxic (``on``) and other texts (``off``), the share of toxic
    texts, and each voter's weight, less than 1 for voters that depend on others."""

    def __init__(self, share: float, on: np.ndarray, off: np.ndarray, weight: np.ndarray):
        self.share, self.weight = share, weight
        self.on, self.off = (np.clip(x, 1e-4, 1 - 1e-4) for x in (on, off))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fire = self.weight * np.log(self.on / self.off)
        rest = self.weight * np.log((1 - self.on) / (1 - self.off))
        odds = math.log(self.share / (1 - self.share)) + votes @ (fire - rest) + rest.sum()
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def sums(self, width: int):
        """Expected class sizes, firings and joint firings, summed inside each task."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, width + 1, width))
            for batch in batches:
                votes = _matrix(batch.column("votes"), width)
                label = np.array([-1.0 if x is None else float(x) for x in batch.column("label").to_pylist()])
                p = np.where(label < 0, self.posterior(votes), label)
                for k, q in enumerate((1 - p, p)):
                    total[k, 0, 0] += q.sum()
                    total[k, 1:] += (votes * q[:, None]).T @ votes
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], names=["place", "value"])
        return run


def fit_label_model(votes: DataFrame, width: int, share: float, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over ``votes(label, votes)``; the label is null where it may not be seen."""
    def estimate(model: LabelModel, rows: DataFrame) -> LabelModel:
        total = np.zeros(2 * (width + 1) * width)
        summed = rows.select("label", "votes").mapInArrow(model.sums(width), "place long, value double")
        for r in summed.groupBy("place").agg(F.sum("value").alias("value")).collect():  # 2 (width + 1) width at most
            total[r["place"]] = r["value"]
        total = total.reshape(2, width + 1, width)
        size, joint = total[:, 0, 0], total[:, 1:]
        rate = [(np.diag(joint[k]) + 0.1) / (size[k] + 1.0) for k in (0, 1)]
        # correlation of votes within the toxic class: what a voter shares with others counts once
        both = joint[1] / max(size[1], 1.0)
        spread = np.sqrt(np.maximum(rate[1] * (1 - rate[1]), 1e-9))
        correlation = (both - np.outer(rate[1], rate[1])) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + np.clip(correlation, 0, 1).sum(1))
        return LabelModel(min(max(size[1] / max(size.sum(), 1.0), 1e-4), 0.5), rate[1], rate[0], weight)

    model = estimate(LabelModel(share, np.full(width, 0.2), np.full(width, 0.01), np.ones(width)), votes.filter("label is not null"))
    model.share = share
    for _ in range(rounds):
        model = estimate(model, votes)
    return model


def _soft_rows(model: LabelModel, width: int, known: np.ndarray, voters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = _vote(voters)
        for batch in batches:
            for part, words in chunks(batch, "text", ALNUM_SPLIT, lower=True):
                voted = next(vote(iter([part])))
                doc, at = _found(words, known)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = [at[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(model.posterior(_matrix(voted.column("votes"), width))),
                     pa.array(lists, pa.list_(pa.int32()))], names=["label", "p", "found"])
    return run


def _score(known: np.ndarray, weights: np.ndarray, intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in chunks(batch, "text", ALNUM_SPLIT, lower=True):
                doc, at = _found(words, known)
                odds = intercept + np.bincount(doc, weights=weights[at], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))],
                                                 names=["id", "score"])
    return run


def calibrate(odds: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve from odds to the label, by Newton's method; classes are
    weighted to ``share`` and targets drawn in a little, so that separable classes have a fit."""
    n1, n0 = max((label == 1).sum(), 1), max((label == 0).sum(), 1)
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, share / n1, (1 - share) / n0) * len(label)
    centre, scale = odds.mean(), odds.std() + 1e-9
    x = np.column_stack([(odds - centre) / scale, np.ones(len(odds))])
    beta = np.array([1.0, math.log(share / (1 - share))])
    loss = lambda b: float((weight * (np.logaddexp(0, x @ b) - target * (x @ b))).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        slope = x.T @ (weight * (p - target))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta[0] / scale, beta[1] - beta[0] * centre / scale


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", sample_per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Rows ``(id, held_out, score, predicted)``, one per input row."""
    rows = only(docs, id=id_col, text=text_col)
    kind = dict(rows.dtypes)["id"]
    train = (only(labels, id=id_col, label=label_col).filter(~is_held_out(F.col("id"))).filter("label in (0, 1)")
             .groupBy("id").agg(F.max("label").cast("int").alias("label")))
    shares = train.agg(F.avg("label").alias("share"), F.count("*").alias("n")).first()
    share = shares["share"] or 0.0
    out = rows.select("id", F.lit(0.0).alias("score"))
    if 0 < share < 1:
        # the smallest hashes of each class; the cut before the sort leaves about twice the sample
        order, top = F.pmod(F.xxhash64("id"), F.lit(1 << 40)), float(1 << 40)
        sizes = {1: share * shares["n"], 0: (1 - share) * shares["n"]}
        picked = [train.filter((F.col("label") == k) & (order < F.lit(min(1.0, (2 * sample_per_class + 100) / sizes[k]) * top)))
                  .orderBy(order, "id").limit(sample_per_class) for k in (0, 1)]
        sample_ids = written(picked[0].union(picked[1]), "tox-sample")  # bounded: broadcast
        sample = written(rows.join(F.broadcast(sample_ids.select("id", F.col("label").alias("toxic"))), "id"), "tox-texts")
        known, weights, intercept = _fit(rows, sample, sample_ids, share)
        out = rows.mapInArrow(_score(known, weights, intercept), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _fit(rows: DataFrame, sample: DataFrame, sample_ids: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    counted = (sample.select("text", "toxic").mapInArrow(_count_features, "feature long, toxic long, n long")
               .groupBy("feature").agg(F.sum("toxic").alias("a"), (F.sum("n") - F.sum("toxic")).alias("b"))
               .filter(F.col("a") + F.col("b") >= MIN_SUPPORT))
    on, off = (F.col("a") + 0.5) / (n1 + 1.0), (F.col("b") + 0.5) / (n0 + 1.0)
    counted = counted.withColumn("ratio", on / off).withColumn(
        "gap", (on - off) / F.sqrt(on * (1 - on) / (n1 + 1.0) + off * (1 - off) / (n0 + 1.0)))
    counted = written(counted, "tox-counts")
    voters = [r["feature"] for r in counted.filter((F.col("ratio") >= MIN_RATIO) & (F.col("a") >= MIN_SUPPORT))
              .orderBy(F.desc("gap"), "feature").limit(VOTERS).collect()]
    features = [r["feature"] for r in counted.orderBy(F.desc(F.abs("gap")), "feature").limit(FEATURES).collect()]
    voters = np.sort(np.array(voters, dtype=np.int64).view(np.uint64))
    known = np.sort(np.array(features, dtype=np.int64).view(np.uint64))
    width = len(voters) + N_PATTERNS

    labelled = rows.join(F.broadcast(sample_ids), "id", "left")
    kind = dict(rows.dtypes)["id"]
    votes = written(labelled.mapInArrow(_vote(voters), f"id {kind}, label int, votes array<int>"), "tox-votes")
    model = fit_label_model(votes, width, share)

    soft = sample.select(F.col("id"), "text", F.col("toxic").alias("label"))
    sparse = F.udf(lambda found: Vectors.sparse(len(known), sorted(found), [1.0] * len(found)), VectorUDT())
    rows_in = written(soft.mapInArrow(_soft_rows(model, width, known, voters), "label int, p double, found array<int>"), "tox-soft")
    both = rows_in.select(sparse("found").alias("features"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("soft")).select("features", "soft.*")
    fitted = LogisticRegression(weightCol="weight", regParam=REGULARISATION, maxIter=60, standardization=False).fit(both)
    weights, intercept = fitted.coefficients.toArray(), float(fitted.intercept)
    rated = rows_in.select("label", "found").toPandas()  # the bounded sample
    odds = np.array([intercept + weights[f].sum() for f in rated.found])
    slope, shift = calibrate(odds, rated.label.to_numpy(), share)
    return known, weights * slope, intercept * slope + shift
