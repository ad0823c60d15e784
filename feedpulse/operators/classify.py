"""Classifier scoring (M3, M4, M5, M7).

* ``decode_logits`` (M3) is native: softmax, argmax and the label map are
  array higher-order functions, no Python.
* ``score_with_model`` (M4) is the one place a user model runs: an
  Arrow-batched ``mapInPandas`` that builds the model once per Python worker
  (the factory is called lazily inside the task, so weights are loaded on the
  executor, not shipped through the driver) and returns raw logits; decoding
  stays native.  Blank texts keep their row (D9): they get null logits and
  decode to the (0, 0) fallback.
"""

from __future__ import annotations

import time
from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .. import vocab
from ..functions.text import sanitize, social_preprocess


def decode_logits(logits, labels: Sequence[str] = vocab.CLASSIFIER_LABELS,
                  label_values: dict | None = None) -> Column:
    """M3: ``STRUCT<value, confidence, label>`` from a logit vector.

    Unknown labels map to 0.0; a null vector decodes to null (M7 fills it).
    """
    lv = label_values or vocab.LABEL_VALUES
    x = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - m))
    z = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    probs = F.transform(ex, lambda v: v / z)
    pmax = F.array_max(probs)
    idx = F.array_position(probs, pmax)
    label = F.element_at(F.array(*[F.lit(s) for s in labels]), idx.cast("int"))
    value = F.coalesce(F.element_at(F.create_map(*[y for k, v in lv.items()
                                                   for y in (F.lit(k), F.lit(float(v)))]), label),
                       F.lit(0.0))
    return F.when(x.isNull(), F.lit(None)).otherwise(
        F.struct(value.alias("value"), pmax.alias("confidence"), label.alias("label")))


def score_with_model(df: DataFrame, model_factory: Callable[[], Callable[[list[str]], list]],
                     text_col: str = "text", id_col: str = "id", keep: Sequence[str] = (),
                     n_labels: int = 3, batch_size: int = 32) -> DataFrame:
    """M4: run a user model over Arrow batches; output ``id, *keep, logits, error, inference_ms``.

    A text for which the model fails keeps its row, with null logits and the error (M7): a
    batch that fails is scored again text by text.  A model that returns another number
    of results than texts, or of logits than ``n_labels``, is a wrong model: the job fails.

    ``inference_ms`` is the time of the model's batch, shared evenly by its texts; null for blank texts.

    ``model_factory()`` returns ``predict(texts) -> list[list[float]]``; it is
    invoked once per task inside the executor.  ``batch_size`` is the model
    batch inside each Arrow batch.
    """
    cols = [id_col, *keep, text_col]
    out_schema = (df.select(*[F.col(c) for c in [id_col, *keep]]).schema
                  .add("logits", ArrayType(DoubleType())).add("error", StringType()).add("inference_ms", DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model_factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str)
            logits: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            times: list = [None] * len(texts)
            live = [i for i, t in enumerate(texts) if t.strip()]
            for s in range(0, len(live), batch_size):
                chunk = live[s:s + batch_size]
                batch = [texts.iloc[i] for i in chunk]
                begin = time.perf_counter()
                try:
                    preds = list(predict(batch))
                except Exception:  # noqa: BLE001 - each text on its own, the error goes into its row
                    preds = []
                    for i, text in zip(chunk, batch):
                        try:
                            preds.extend(predict([text]))
                        except Exception as e:  # noqa: BLE001
                            preds.append(None)
                            errors[i] = f"{type(e).__name__}: {e}"
                each = (time.perf_counter() - begin) * 1000 / len(chunk)
                if len(preds) != len(chunk):
                    raise ValueError(f"the model returned {len(preds)} results for {len(chunk)} texts")
                for i, p in zip(chunk, preds):
                    times[i] = each
                    if p is None:
                        continue
                    logits[i] = [float(v) for v in p]
                    if len(logits[i]) != n_labels:
                        raise ValueError(f"the model returned {len(logits[i])} logits for {n_labels} labels")
            res = pdf[[id_col, *keep]].copy()
            res["logits"] = logits
            res["error"] = pd.Series(errors, index=res.index, dtype=object)
            res["inference_ms"] = pd.Series(times, index=res.index, dtype="float64")
            yield res

    return df.select(*cols).mapInPandas(run, out_schema)


def classifier_scores(df: DataFrame, model_factory, model_name: str = "finbert",
                      text_col: str = "text", keep: Sequence[str] = ("source", "created_at"),
                      social: bool = False, labels: Sequence[str] = vocab.CLASSIFIER_LABELS,
                      batch_size: int = 32, details: bool = False) -> DataFrame:
    """M4 + M3 (+ T1 / T5 preprocessing) -> long-form score rows (M7 filled); with ``details``
    also each row's ``error`` and ``inference_ms``."""
    prep = social_preprocess(F.col(text_col)) if social else sanitize(F.col(text_col))
    pre = df.select("id", *keep, prep.alias("__t"))
    lg = score_with_model(pre, model_factory, text_col="__t", keep=list(keep), n_labels=len(labels),
                          batch_size=batch_size)
    dec = decode_logits("logits", labels)
    return lg.select(
        "id", *keep, F.lit(model_name).alias("model"),
        F.coalesce(dec["value"], F.lit(0.0)).alias("value"),
        F.coalesce(dec["confidence"], F.lit(0.0)).alias("confidence"),
        dec.isNotNull().alias("ok"), *(["error", "inference_ms"] if details else []),
    )


def social_classifier_scores(df: DataFrame, model_factory, **kw) -> DataFrame:
    """M5: T5 preprocessing, then M4 + M3 under the name ``twitter_roberta``."""
    kw.setdefault("model_name", "twitter_roberta")
    return classifier_scores(df, model_factory, social=True, **kw)


def fill_failed(score: Column, model_name: str) -> Column:
    """M7: a null score struct becomes ``(0.0, 0.0, model_name)``."""
    return F.coalesce(score, F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("confidence"),
                                      F.lit(model_name).alias("model_name")))


class KeywordStubModel:
    """Deterministic stand-in classifier for tests and the bench (no model is
    available offline).  Logits = (negative, neutral, positive) word counts."""

    def __init__(self, positive: Sequence[str] = ("great", "moon", "promising", "up", "good"),
                 negative: Sequence[str] = ("crash", "hacked", "weak", "down", "bad")):
        self.pos = {w.lower() for w in positive}
        self.neg = {w.lower() for w in negative}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            words = t.lower().split()
            p = sum(w.strip(".,!?") in self.pos for w in words)
            n = sum(w.strip(".,!?") in self.neg for w in words)
            out.append([float(n), 0.5, float(p)])
        return out
