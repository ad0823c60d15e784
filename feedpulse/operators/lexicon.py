"""Lexicon sentiment (M1, M2).

A text is scored inside its row while the lexicon is small (``MAX_PACKED_BYTES``, checked)::

    scan -> project(sanitize, split, positions of candidates, fold over these)

A word is a candidate if its letters, without any punctuation, are those of some entry's first
word: one set probe a word.  Only candidates are looked at again, for the longest entry there (entries
may be phrases of several words; they travel with the plan as buckets by a hash), the words
before it and the emphasis rules.  Nothing is exploded, joined or shuffled.

A larger lexicon is joined instead::

    scan -> project(sanitize, split, per-token context in-array)
         -> generate(explode) -> join(lexicon)                    # broadcast while small
         -> partial HashAggregate(id) -> Exchange -> final HashAggregate

There each document adds one anchor row, so documents without hits keep ``value = 0``.

Rules and constants are those of the published VADER method (Hutto &
Gilbert, 2014).  Tier A: valence sum, negation, normalisation.  Tier B
(``emphasis=True``): all-caps emphasis, degree words ("very", "slightly"), the
"but" shift and '!'/'?' amplification.
"""

from __future__ import annotations

import json
import zlib
from typing import Callable, Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.mentions import _let
from ..functions.text import sanitize
from .broadcast import maybe_broadcast

# ASCII punctuation (Python's string.punctuation) as explicit ranges, portable
# between Java regex and RE2.
PUNCT = r"[!-/:-@\[-`{-~]"
# the same set as a character list (for btrim)
PUNCT_CHARS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
STRIP_PUNCT = rf"^{PUNCT}+|{PUNCT}+$"
MAX_LEXICON_ROWS = 2_000_000
#: Lexicons up to this size (UTF-8 bytes of their entries) travel with the plan.
MAX_PACKED_BYTES = 1 << 19
#: The longest entry of such a lexicon in bytes.
MAX_ENTRY = 1024

# FIXED VALUES: fixture lexicon entries (FIXTURES.md sections 2 and 3a)
FIXTURE_LEXICON = {
    "great": 3.1, "crash": -1.7, "promising": 1.7, "hacked": -1.7,
}
DATA_LEXICON = {
    "this": 0.9, "with": 1.2, "from": -0.8, "that": -0.6, "are": -0.4, "was": 0.5,
    "for": 0.8, "und": 1.1, "mit": -1.3, "pour": 0.7, "que": -0.9, "para": 1.0,
}
DATA_NEGATORS = ["of", "de", "von"]


def lexicon_frame(spark: SparkSession, entries: Mapping[str, float]) -> DataFrame:
    """Lexicon as a ``(token STRING, valence DOUBLE)`` DataFrame."""
    # as an Arrow table, which becomes a local relation: no Python worker where the lexicon is read
    rows = pa.table({"token": pa.array([k.lower() for k in entries], pa.string()),
                     "valence": pa.array([float(v) for v in entries.values()], pa.float64())})
    return spark.createDataFrame(rows)


def overlay(base: DataFrame, extra: DataFrame, max_broadcast_rows: int = MAX_LEXICON_ROWS) -> DataFrame:
    """M2: entries of ``extra`` replace same-token entries of ``base``
    (anti join against the overlay keys, broadcast behind a size check)."""
    keys = maybe_broadcast(extra.select("token"), max_broadcast_rows)
    return base.join(keys, "token", "left_anti").unionByName(extra)


def default_lexicon(spark: SparkSession, base: Mapping[str, float] | None = None) -> DataFrame:
    """Fixture base lexicon with the domain overlay applied on top."""
    b = lexicon_frame(spark, base if base is not None else FIXTURE_LEXICON)
    return overlay(b, lexicon_frame(spark, vocab.CRYPTO_LEXICON_OVERLAY))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file in the published tab-separated form (``token, mean valence, ...``; no header) as
    ``(token, valence)``.  Of repeated tokens the last line counts; blank lines are skipped, and a line
    without a token and a number fails the job with the line's token."""
    raw = spark.read.option("sep", "\t").option("quote", "").schema("token string, valence string").csv(path)
    valence = F.col("valence").try_cast("double")
    wrong = F.raise_error(F.concat(F.lit("lexicon line without a token and a valence: "), F.coalesce("token", F.lit("?"))))
    checked = F.when(F.col("token").isNull() | valence.isNull(), wrong).otherwise(valence)
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = raw.select(F.lower("token").alias("token"), checked.alias("valence"), line.alias("line"))
    return lines.groupBy("token").agg(F.max_by("valence", "line").alias("valence"))


def word_form(raw: Column) -> Column:
    """Lexicon word form of one whitespace token: ASCII punctuation stripped
    from both ends when more than two characters remain, else the token."""
    s = F.btrim(raw, F.lit(PUNCT_CHARS))
    return F.when(F.length(s) <= 2, raw).otherwise(s)


def _shifted(arr: Column, k: int) -> Column:
    """Element i of the result is element i-k of ``arr`` ('' before the start)."""
    pad = F.array(*[F.lit("") for _ in range(k)])
    return F.slice(F.concat(pad, arr), 1, F.size(arr))


def _bucketed(entries: Mapping[str, float], kind: str) -> Column:
    """A constant lookup table: as many maps as ``entries`` (up to a power of two), by the entry's CRC-32."""
    size = 1 << max(len(entries) - 1, 0).bit_length()
    buckets: list[dict] = [{} for _ in range(size)]
    for word, value in entries.items():
        buckets[zlib.crc32(word.encode()) % size][word] = value
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")


class PackedLexicon:
    """A lexicon of checked size as constant lookup tables.

    ``entries``: entry -> valence.  An entry of several words (joined by one space) is a phrase;
    a phrase wins over entries inside it, and of phrases that start at one word the longest.
    """

    def __init__(self, entries: Mapping[str, float]):
        self.size = 1 << max(len(entries) - 1, 0).bit_length()
        self.entries = _bucketed(entries, "double")
        self.longest = max((e.count(" ") + 1 for e in entries), default=1)
        starts: dict[str, int] = {}
        for e in entries:
            first, n = e.split(" ", 1)[0], e.count(" ") + 1
            starts[first] = max(n, starts.get(first, 0))
        self.start_size = 1 << max(len(starts) - 1, 0).bit_length()
        self.starts = _bucketed(starts, "int")
        bare = str.maketrans("", "", PUNCT_CHARS)
        self.candidates = sorted({w.translate(bare) for w in starts})

    @staticmethod
    def _probe(table: Column, size: int, word: Column) -> Column:
        return F.try_element_at(F.get(table, F.crc32(word.cast("binary")) % size), word)

    def valence(self, entry: Column) -> Column:
        return self._probe(self.entries, self.size, entry)

    def words_from(self, word: Column) -> Column:
        """The number of words of the longest entry that starts with ``word``, null without one."""
        return self._probe(self.starts, self.start_size, word)

    def candidate_positions(self, clean: Column) -> Column:
        """Positions (from 0) of the words of ``clean`` that may start an entry; each such word is among them."""
        bare = F.split(F.translate(F.lower(clean), PUNCT_CHARS, ""), " ", -1)
        return F.filter(F.transform(bare, lambda w, i: F.when(w.isin(self.candidates), i)), lambda i: i.isNotNull())


def pack_lexicon(lexicon: DataFrame, max_bytes: int = MAX_PACKED_BYTES) -> PackedLexicon | None:
    """``lexicon`` for scoring inside the row, or None where it is larger than ``max_bytes`` or repeats
    a token (a join counts such a token once per row).  Rows with a null are no entries.

    Raises ValueError for phrases in a lexicon that can't be packed: a join by words does not see them.
    """
    known = lexicon.select("token", "valence").where(F.col("token").isNotNull() & F.col("valence").isNotNull())
    # an entry takes 8 bytes and its text, so more rows than this are too large; of each row at most MAX_ENTRY is read
    most = max_bytes // 8
    text = F.when(F.octet_length("token") <= MAX_ENTRY, F.col("token"))
    rows = known.select(text.alias("token"), "valence").limit(most + 1).collect()
    entries = {r["token"]: r["valence"] for r in rows}
    fits = len(rows) <= most and None not in entries and sum(len(e.encode()) + 8 for e in entries) <= max_bytes
    if fits and len(entries) == len(rows):
        return PackedLexicon(entries)
    if not known.where(F.col("token").contains(" ")).isEmpty():
        raise ValueError(f"a lexicon with phrases must have unique entries and at most {max_bytes} bytes")
    return None


def _form(w: Column) -> Column:
    return F.lower(word_form(w))


def _valence_in_context(valence: Column, w: Column, before: Sequence[Column], position: Column, mixed: Column | None,
                        but: Column | None, negators: Sequence[str], boosters: Mapping[str, float]) -> Column:
    """The valence of an entry ``w`` at ``position`` (from 1) after the words ``before`` it, nearest first ('' where
    the text has none).  ``mixed`` and ``but`` are those of tier B, or None."""
    v = valence
    if mixed is not None:
        def loud(x: Column) -> Column:
            return F.when(mixed & _isupper(x), F.lit(vocab.CAPS_INCREMENT)).otherwise(F.lit(0.0))
        v = v + F.signum(v) * loud(w)
        if boosters:
            by_word = F.create_map(*[F.lit(x) for k, b in boosters.items() for x in (k.lower(), float(b))])

            # what a degree word adds in the direction of the valence, capitals included
            added = sum((F.coalesce(F.try_element_at(by_word, _form(p)) + loud(p), F.lit(0.0)) * damp
                         for p, damp in zip(before, vocab.BOOST_DAMP)), F.lit(0.0))
            v = v + F.signum(valence) * added
        v = (F.when((but > 0) & (position < but), v * vocab.BUT_BEFORE)
             .when((but > 0) & (position > but), v * vocab.BUT_AFTER).otherwise(v))
    if negators:
        low = [n.lower() for n in negators]
        negated = _form(before[0]).isin(low)
        for p in before[1:]:
            negated = negated | _form(p).isin(low)
        v = F.when(negated, v * vocab.NEGATION_SCALAR).otherwise(v)
    return v


def _fold_entries(raw: Column, starts: Column, lexicon: PackedLexicon, value_at: Callable) -> Column:
    """``struct(next, sum, hits)`` over the entries in ``raw``, leftmost first and longest at a word, without overlaps.
    ``starts`` are candidate positions; ``value_at(valence, entry, index)`` is what an entry at an index (from 0) adds."""
    def entry(i: Column, n: int) -> Column:
        """struct(words, valence) if the ``n`` words from ``i`` on are an entry, else null"""
        if n == 1:
            text = _form(F.get(raw, i))
        else:
            text = F.array_join(F.transform(F.slice(raw, i + 1, n), _form), " ")
        found = _let(lexicon.valence(text), lambda v: F.when(
            v.isNotNull(), F.struct(F.lit(n).alias("words"), v.alias("valence"))))
        return F.when(i + n <= F.size(raw), found)

    def longest_at(i: Column) -> Column:
        if lexicon.longest == 1:
            return entry(i, 1)
        return _let(lexicon.words_from(_form(F.get(raw, i))), lambda top: F.coalesce(
            *[F.when(top >= n, entry(i, n)) for n in range(lexicon.longest, 0, -1)]))

    def step(acc: Column, i: Column) -> Column:
        def add(hit: Column) -> Column:
            text = F.array_join(F.slice(raw, i + 1, hit["words"]), " ")
            return F.when(hit.isNull(), acc).otherwise(F.struct(
                (i + hit["words"]).alias("next"), (acc["sum"] + value_at(hit["valence"], text, i)).alias("sum"),
                (acc["hits"] + 1).alias("hits")))
        return F.when(i < acc["next"], acc).otherwise(_let(longest_at(i), add))
    zero = F.struct(F.lit(0).alias("next"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("hits"))
    return F.aggregate(starts, zero, step)


def _score_in_row(df: DataFrame, lexicon: PackedLexicon, id_col: str, text_col: str, keep: list[str],
                  negators: Sequence[str], emphasis: bool, boosters: Mapping[str, float]) -> DataFrame:
    """``id_col, *keep, __ok, __s, hits`` (and ``__amp``), one row per row of ``df``."""
    clean = df.select(F.col(id_col), *[F.col(k) for k in keep], sanitize(F.col(text_col)).alias("__clean"))
    ok = F.coalesce(F.length("__clean") >= 1, F.lit(False))
    words = F.when(ok, F.split("__clean", " ", -1)).otherwise(F.array().cast("array<string>"))
    starts = F.when(ok, lexicon.candidate_positions(F.col("__clean"))).otherwise(F.array().cast("array<int>"))

    def folded(raw: Column, mixed: Column | None, but: Column | None) -> Column:
        def value_at(valence: Column, text: Column, i: Column) -> Column:
            before = [F.coalesce(F.get(raw, i - k), F.lit("")) for k in (1, 2, 3)]
            return _valence_in_context(valence, text, before, i + 1, mixed, but, negators, boosters)
        return _fold_entries(raw, starts, lexicon, value_at)

    def of_words(raw: Column) -> Column:
        if not emphasis:
            return folded(raw, None, None)
        mixed = F.exists(raw, _isupper) & F.exists(raw, lambda w: ~_isupper(w))
        but = F.array_position(F.transform(raw, _form), "but").cast("int")
        return _let(F.struct(mixed.alias("mixed"), but.alias("but")), lambda c: folded(raw, c["mixed"], c["but"]))
    out = clean.select(id_col, *keep, ok.alias("__ok"), _let(words, of_words).alias("__fold"),
                       *([_punct_amplifier(F.col("__clean")).alias("__amp")] if emphasis else []))
    return out.withColumns({"__s": F.col("__fold.sum"), "hits": F.col("__fold.hits")}).drop("__fold")


def _score_by_join(df: DataFrame, lexicon: DataFrame, id_col: str, text_col: str, keep: list[str],
                   negators: Sequence[str], emphasis: bool, boosters: Mapping[str, float], max_broadcast_rows: int,
                   lexicon_rows: int | None) -> DataFrame:
    """As ``_score_in_row``, one row per distinct id with its kept columns."""
    base = df.select(F.col(id_col), *[F.col(k) for k in keep], sanitize(F.col(text_col)).alias("__clean"))
    base = base.withColumn("__ok", F.coalesce(F.length("__clean") >= 1, F.lit(False)))
    # per-document constants ride along as grouping keys (functionally
    # dependent on the id), so no join back to the documents is needed
    carry = [id_col, *keep, "__ok"]
    raw = F.when(F.col("__ok"), F.split("__clean", " ", -1)).otherwise(F.array().cast("array<string>"))
    cols = [*carry, raw.alias("__r")]
    if emphasis:
        # position (1-based, 0 if absent) of the first "but" word
        cols += [_punct_amplifier(F.col("__clean")).alias("__amp"),
                 F.array_position(F.transform(raw, _form), "but").cast("int").alias("__but")]
    words = base.select(*cols)
    extra = []
    if emphasis:
        carry.extend(["__amp", "__but"])
        extra = ["__mixed"]
        # caps emphasis applies only when the text mixes all-caps and other words
        words = words.withColumn("__mixed", F.exists("__r", _isupper) & F.exists("__r", lambda w: ~_isupper(w)))
    # Neighbour context comes from shifted copies zipped element-wise: no
    # lambda reads another element and no token row carries the whole array.
    zipped = F.arrays_zip(F.col("__r").alias("w"), _shifted(F.col("__r"), 1).alias("p1"),
                          _shifted(F.col("__r"), 2).alias("p2"), _shifted(F.col("__r"), 3).alias("p3"))
    # posexplode_outer keeps one (null) row for a document without tokens
    tokens = (words.select(*carry, *extra, F.posexplode_outer(zipped).alias("__pos", "t"))
              .select(*carry, *extra, "__pos", "t.*").withColumn("token", _form(F.col("w"))))
    lex = maybe_broadcast(lexicon.select("token", "valence"), max_broadcast_rows, lexicon_rows)
    # left join + filter: lexicon hits plus one anchor row per document reach
    # the aggregate, so documents without hits keep value 0 in one pass
    joined = (tokens.join(lex, "token", "left")
              .where(F.col("valence").isNotNull() | F.col("__pos").isNull() | (F.col("__pos") == 0)))
    mixed, but = (F.col("__mixed"), F.col("__but")) if emphasis else (None, None)
    v = _valence_in_context(F.col("valence"), F.col("w"), [F.col(p) for p in ("p1", "p2", "p3")], F.col("__pos") + 1,
                            mixed, but, negators, boosters)
    return joined.groupBy(*carry).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("__s"), F.count("valence").alias("hits"))


def lexicon_score(df: DataFrame, lexicon: DataFrame, id_col: str = "id",
                  text_col: str = "text", keep: Iterable[str] = (),
                  negators: list[str] | None = None, emphasis: bool = False,
                  model_name: str = "vader", max_broadcast_rows: int = MAX_LEXICON_ROWS,
                  lexicon_rows: int | None = None, boosters: Mapping[str, float] | None = None,
                  max_packed_bytes: int = MAX_PACKED_BYTES) -> DataFrame:
    """M1: one score row per input row.

    Output: ``id_col, *keep, value, confidence, model_name, ok, hits`` where
    ``boosters`` (degree word -> added intensity; tier B, the published list by default) act on
    the three words after them.
    ``ok`` is false for texts that are empty after sanitising (they score 0, 0).
    A lexicon of more than ``max_packed_bytes`` is joined: then ids must be unique.
    """
    negators = vocab.NEGATORS if negators is None else list(negators)
    boosters = vocab.BOOSTERS if boosters is None else boosters
    keep = list(keep)
    packed = pack_lexicon(lexicon, max_packed_bytes)
    if packed is not None:
        agg = _score_in_row(df, packed, id_col, text_col, keep, negators, emphasis, boosters)
    else:
        agg = _score_by_join(df, lexicon, id_col, text_col, keep, negators, emphasis, boosters, max_broadcast_rows, lexicon_rows)
    s = F.col("__s")
    if emphasis:
        s = F.when(s > 0, s + F.col("__amp")).when(s < 0, s - F.col("__amp")).otherwise(s)
    compound = F.least(F.greatest(s / F.sqrt(s * s + F.lit(vocab.NORMALIZE_ALPHA)),
                                  F.lit(-1.0)), F.lit(1.0))
    return agg.select(
        id_col, *keep,
        compound.alias("value"),
        F.abs(compound).alias("confidence"),
        F.lit(model_name).alias("model_name"),
        F.col("__ok").alias("ok"),
        "hits",
    )


def _isupper(w: Column) -> Column:
    """Python ``str.isupper``: has a cased character and no lower-case one."""
    return (w == F.upper(w)) & (w != F.lower(w))


def _punct_amplifier(clean: Column) -> Column:
    """Tier B: up to four '!' add 0.292 each; '?' adds 0.18 each up to three,
    0.96 beyond."""
    ex = F.least(F.length(clean) - F.length(F.regexp_replace(clean, "!", "")), F.lit(4))
    q = F.length(clean) - F.length(F.regexp_replace(clean, r"\?", ""))
    qa = F.when(q > 3, F.lit(vocab.QUESTION_INCREMENT_LARGE)) \
        .when(q > 1, q * vocab.QUESTION_INCREMENT_SMALL).otherwise(F.lit(0.0))
    return ex * vocab.EXCLAIM_INCREMENT + qa


def sentiment_label(value) -> Column:
    """Strict thresholds at +/-0.1."""
    v = F.col(value) if isinstance(value, str) else value
    return (F.when(v > vocab.POSITIVE_ABOVE, "positive")
            .when(v < vocab.NEGATIVE_BELOW, "negative").otherwise("neutral"))
