"""Toxicity: held-out quality, and that nothing but training labels is read."""

import random
import zlib

import numpy as np

from feedpulse.llm.toxicity import LabelModel, calibrate, score_toxicity

from .conftest import ODD_ROWS, words


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def make(n=900):
    r = random.Random(1)
    bad = ["idiotic", "scummy", "stupidly", "moronic", "vilest", "trashy"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = words(i, r.randrange(20, 60), 300)
        for _ in range(3 * toxic):
            text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text)))
        if i % 10 < 7:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_quality_and_flags(spark, frame):
    rows, labels = make()
    got = score_toxicity(frame(rows + ODD_ROWS[:6]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) + 6
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held_out(r["doc_id"]) for r in got)
    unseen = [r for r in got[:] if r["doc_id"] >= 10 and (r["held_out"] or r["doc_id"] % 10 >= 7)]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in unseen) >= 0.97 * len(unseen)


def test_held_out_labels_do_not_matter(spark, frame):
    rows, labels = make(400)
    turned = [(i, q, 1 - t if held_out(i) else t) for i, q, t in labels]
    one, other = (sorted(score_toxicity(frame(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
                  for x in (labels, turned))
    assert one == other


def test_one_class_and_empty_tables(spark, frame):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score_toxicity(frame(ODD_ROWS), labels).collect()} == {0.0}
    assert score_toxicity(frame([]), labels).collect() == []
    assert len(score_toxicity(frame(ODD_ROWS), labels.limit(0)).collect()) == len(ODD_ROWS)


def test_dependent_voters_count_once():
    alone = LabelModel(0.1, np.array([0.5, 0.01]), np.array([0.01, 0.01]), np.ones(2))
    twice = LabelModel(0.1, np.array([0.5, 0.5]), np.array([0.01, 0.01]), np.array([0.5, 0.5]))
    assert np.isclose(alone.posterior(np.array([[1, 0]]))[0], twice.posterior(np.array([[1, 1]]))[0])


def test_calibration_finds_the_cut():
    odds = np.concatenate([np.linspace(-9, -4, 500), np.linspace(-2, 3, 500)])
    label = np.repeat([0, 1], 500)
    slope, shift = calibrate(odds, label, 0.1)
    assert ((odds * slope + shift > 0) == (label == 1)).mean() > 0.99
