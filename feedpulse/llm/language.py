"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied into one posterior per row:

* text: naive Bayes over lower-cased byte trigrams of the whole text.  The tables are counted
  over all rows, by the language that the row declares, and smoothed;
* declared markup language (``lang`` of the markup, or a metadata column) and address suffix
  (a language step of the path, else the country suffix of the host): each is a noisy
  channel, whose confusion table is counted against what the text alone says;
* host prior: languages per host, shrunk towards those of the host above it, these towards
  the whole table (hierarchical smoothing), all by grouped aggregation.

A row is rejected when its text has no letters to judge (``und``), when a background of
evenly spread trigrams explains the text better than any language, or when the winning
language is not wanted.

Text tables have a fixed size (languages x trigram cells), whatever the input; counts are summed
inside tasks and then by cell.  Host tables are joined, not collected.

Defined cases: a null, empty or letter-free text is ``und`` and rejected; null declared
language, url or host just give no evidence; equal posteriors go to the first language in
order; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, written
from .words import text_buffers

LANGUAGES = ("de", "en", "es", "fr")
CELL_BITS = 16
CHUNK_BYTES = 1 << 21
SMOOTHING = 0.5
#: Weight of one trigram: neighbouring trigrams overlap, so each counts for less than one fact.
EVIDENCE = 0.3
#: The background wins if it is better by this much per trigram.
BACKGROUND_MARGIN = 1.5
HOST_STRENGTH, PARENT_STRENGTH, GLOBAL_STRENGTH, CHANNEL_STRENGTH = 10.0, 20.0, 4.0, 2.0
UNDETERMINED = "und"
#: Country suffixes that speak for a language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en", "us": "en",
                   "au": "en", "ie": "en"}


def _letters() -> np.ndarray:
    """Byte -> code: letters keep themselves in lower case, any run of others is a blank (0)."""
    table = np.zeros(256, dtype=np.uint32)
    table[0x80:] = np.arange(0x80, 0x100)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    return table


def trigram_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(cell, text)`` of the byte trigrams that hold at least two letters."""
    code = _letters()[data]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = code[:-2], code[1:-1], code[2:]
    cell = ((a * np.uint32(961) + b) * np.uint32(961) + c) * np.uint32(2654435761) >> np.uint32(32 - CELL_BITS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (text[:-2] == text[2:]) & (b > 0) & ((a > 0) | (c > 0))
    return cell[inside].astype(np.int64), text[:-2][inside]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    if not batch.num_rows:
        return
    data, offsets = text_buffers(batch.column("text"))
    row = 0
    while row < batch.num_rows:
        upto = min(max(int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1, row + 1), batch.num_rows)
        at = offsets[row:upto + 1]
        yield batch.slice(row, upto - row), data[at[0]:at[-1]], at - at[0]
        row = upto


def _count_trigrams(languages: tuple[str, ...]):
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 1 << CELL_BITS), dtype=np.int64)
        for batch in batches:
            for part, data, offsets in _chunks(batch):
                language = np.array([place.get(x, -1) for x in part.column("declared").to_pylist()])
                cell, text = trigram_cells(data, offsets)
                of = language[text]
                known = of >= 0
                counts += np.bincount(of[known] * (1 << CELL_BITS) + cell[known],
                                      minlength=counts.size).reshape(counts.shape)
        which, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(cell), pa.array(counts[which, cell])],
                                         names=["language", "cell", "n"])
    return count


def text_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log probability of each trigram cell per language, and of the background in the last row."""
    counted = (rows.select("declared", "text").mapInArrow(_count_trigrams(languages), "language long, cell long, n long")
               .groupBy("language", "cell").agg(F.sum("n").alias("n")))
    counts = np.zeros((len(languages), 1 << CELL_BITS))
    for r in counted.collect():  # at most languages x cells rows
        counts[r["language"], r["cell"]] = r["n"]
    smooth = counts + SMOOTHING
    model = np.log(smooth / smooth.sum(1, keepdims=True))
    # the background spreads evenly over the cells that text of any language uses
    used = max(1, int((counts.sum(0) > 0).sum()))
    return np.vstack([model, np.full(1 << CELL_BITS, -np.log(used))])


def _score_texts(model: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _chunks(batch):
                cell, text = trigram_cells(data, offsets)
                n = np.bincount(text, minlength=part.num_rows)
                sums = [np.bincount(text, weights=row[cell], minlength=part.num_rows) for row in model]
                likelihood = np.stack(sums, 1).astype(np.float64)  # counts of an empty chunk are integers
                flat = pa.array(likelihood.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(model)), flat)
                columns = [part.column(c) for c in part.schema.names if c != "text"]
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), lists], names=[*names, "trigrams", "likelihood"])
    return score


def declared_in_markup(html: Column) -> Column:
    """``lang`` of the html element."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit(""))


def language_of_address(url: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """A language step of the path, else the language of the host's country suffix."""
    step = F.regexp_extract(url, r"(?i)://[^/?#]*/(" + "|".join(languages) + r")(?:[/?#]|$)", 1)
    suffix = F.lower(F.regexp_extract(url, r"(?i)://[^/?#]*\.([a-z]{2})(?:[:/?#]|$)", 1))
    spoken = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    return F.coalesce(F.nullif(F.lower(step), F.lit("")), spoken[suffix])


def parent_host(host: Column) -> Column:
    """The last two labels of a host name; a name without dots is its own parent's child."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), "."))


def _channel(scored: DataFrame, signal: str, languages: tuple[str, ...]) -> Column:
    """log P(signal | language) as an array column, from counts of signal against text language."""
    seen = (scored.filter(F.col(signal).isNotNull() & (F.col("trigrams") > 0) & F.col(signal).isin(*languages))
            .groupBy(signal, "by_text").count().collect())  # at most languages squared rows
    counts = {(r[signal], r["by_text"]): r["count"] for r in seen}
    table = []
    for said in languages:
        row = []
        for true in range(len(languages)):
            total = sum(counts.get((x, true), 0) for x in languages)
            own = CHANNEL_STRENGTH if languages[true] == said else CHANNEL_STRENGTH / 10
            row.append(float(np.log((counts.get((said, true), 0) + own) /
                                    (total + CHANNEL_STRENGTH * (1 + (len(languages) - 1) / 10)))))
        table.append(row)
    silent = F.array(*[F.lit(0.0)] * len(languages))
    out = silent
    for said, row in zip(languages, table):
        out = F.when(F.col(signal) == said, F.array(*[F.lit(x) for x in row])).otherwise(out)
    return out


def host_priors(scored: DataFrame, languages: tuple[str, ...]) -> tuple[DataFrame, list[float]]:
    """``(host, prior)`` with log priors, and those of a row without host.  A host's counts are
    shrunk towards its parent's shares, the parent's towards those of the whole table."""
    ones = [F.sum((F.col("by_text") == i).cast("long")).cast("double").alias(f"n{i}") for i in range(len(languages))]
    by_host = scored.filter("trigrams > 0 and host is not null").groupBy("host", "parent").agg(*ones)
    by_parent = by_host.filter("parent is not null").groupBy("parent").agg(
        *[F.sum(f"n{i}").alias(f"p{i}") for i in range(len(languages))])
    totals = scored.filter("trigrams > 0").agg(*ones).first()
    whole = np.array([totals[i] or 0.0 for i in range(len(languages))]) + GLOBAL_STRENGTH / len(languages)
    whole = whole / whole.sum()

    def shrunk(names: list[str], base: list[Column], strength: float) -> list[Column]:
        counts = [F.coalesce(F.col(c), F.lit(0.0)) for c in names]
        total = sum(counts[1:], counts[0])
        return [(c + F.lit(strength) * b) / (total + F.lit(strength)) for c, b in zip(counts, base)]

    joined = by_host.join(by_parent, "parent", "left")
    parent = shrunk([f"p{i}" for i in range(len(languages))], [F.lit(float(x)) for x in whole], PARENT_STRENGTH)
    host = shrunk([f"n{i}" for i in range(len(languages))], parent, HOST_STRENGTH)
    return (joined.select("host", F.array(*[F.log(x) for x in host]).alias("prior")),
            [float(x) for x in np.log(whole)])


def identify(rows: DataFrame, keys: list[str], text_col: str = "text", declared_col: str | None = None,
             url_col: str | None = None, host_col: str | None = None, languages: tuple[str, ...] = LANGUAGES,
             wanted: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Rows ``(*keys, language, probability, kept)``, one per input row.

    ``declared_col``, ``url_col`` and ``host_col`` name the columns with further evidence, as far
    as the table has them; the host defaults to the url's.
    """
    keep = {f"key{i}": k for i, k in enumerate(keys)}
    named = {"text": text_col, "declared": declared_col, "url": url_col, "host": host_col}
    rows = only(rows, **keep, **{k: v for k, v in named.items() if v})
    for absent in (k for k, v in named.items() if not v):
        rows = rows.withColumn(absent, F.lit(None).cast("string"))
    host = F.coalesce("host", F.nullif(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit("")))
    rows = (rows.withColumn("address", language_of_address(F.col("url"), languages)).withColumn("host", host)
            .withColumn("parent", parent_host(F.col("host"))).withColumn("declared", F.lower(F.substring("declared", 1, 2)))
            .drop("url"))

    model = text_model(rows, languages)
    shape = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text") + ", trigrams long, likelihood array<double>"
    scored = rows.mapInArrow(_score_texts(model), shape)
    n = len(languages)
    by_text = F.array_position(F.slice("likelihood", 1, n), F.array_max(F.slice("likelihood", 1, n))) - 1
    scored = written(scored.withColumn("by_text", by_text.cast("int")), "language-evidence")

    priors, whole = host_priors(scored, languages)
    fused = scored.join(priors, "host", "left").withColumn(
        "prior", F.coalesce("prior", F.array(*[F.lit(x) for x in whole])))
    parts = [F.transform(F.slice("likelihood", 1, n), lambda x: x * EVIDENCE), F.col("prior"),
             _channel(scored, "declared", languages), _channel(scored, "address", languages)]
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda x, y: x + y)
    fused = fused.withColumn("total", total).withColumn("top", F.array_max("total"))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.element_at(names, F.array_position("total", F.col("top")).cast("int"))
    mass = F.aggregate("total", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    judged = F.col("trigrams") > 0
    background = (F.element_at("likelihood", n + 1) - F.array_max(F.slice("likelihood", 1, n))) / F.greatest("trigrams", F.lit(1))
    language = F.when(judged & (background <= BACKGROUND_MARGIN), best).otherwise(F.lit(UNDETERMINED))
    out = fused.withColumn("language", language)
    return out.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "language",
                      F.when(F.col("language") != UNDETERMINED, 1 / mass).otherwise(F.lit(0.0)).alias("probability"),
                      F.col("language").isin(*wanted).alias("kept"))
