"""Token counts of whole texts without token ids.

A byte-pair tokenizer cuts a text into pre-tokens and each of them into pieces, so a text's count is
the sum over its distinct pre-tokens of frequency times pieces.  Pieces are counted once per
distinct pre-token:

1. One scan takes pre-token frequencies per document.  The vocabulary's own strings (a table of
   fixed size) have their number of pieces at hand.  All others are numbered in a dictionary per
   part of about ``PART_BYTES`` of text, and a document keeps (number, frequency).
2. The dictionaries' entries ``(part, number, pre-token)`` are sorted by pre-token in one shuffle;
   each distinct pre-token goes through the merges once, and each entry gets its count.
   A pre-token that all documents have is one entry a part, not one a document.
3. Counts return to their part and are joined to its documents' frequencies, and summed.

No group is larger than a part: some MB of text, or the one text that is longer.

Special strings inside a text are cut out first, as the library does, and count one each.

Defined cases: a null text is empty; an empty text has no tokens; a null id and rows that repeat an
id are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written

LIMIT, PART_BYTES = 512, 1 << 25
#: Entries of a dictionary in a row, documents in a batch.
ENTRIES, DOCS = 4096, 512
NUMBERS = pa.list_(pa.int32())

# FIXED VALUES: the pattern of the byte-level pre-tokenizer
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose classes the pattern above and the library agree whatever edition of Unicode they follow
#: (a test tries each); a text with others is cut by the library itself.
AGREED = r"[\u0000-ԯḀ-⁯₠-₿　-ヿ一-龥가-힣]*"

#: A document, or some entries of the part's dictionary, numbered from ``first``.  ``once`` and ``more`` are the
#: numbers of pre-tokens that the document has once and ``times`` times: ascending, the first one and then steps.
PARTS = ("part long, {id} bytes long, known long, once array<int>, more array<int>, times array<int>, "
         "first int, entries array<string>")


class PreTokens:
    """Cuts texts as ``tokenizers`` does, and counts the pieces of a pre-token."""

    def __init__(self, definition: str):
        self.definition = definition
        spec = json.loads(definition)
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that strip, normalise or match whole words are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        pre = spec["pre_tokenizer"] or {}
        # only where pre-tokens are the text's own substrings
        self.by_pattern = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
                           and spec["normalizer"] is None)
        self.pattern, self.agreed = regex.compile(BYTE_LEVEL), regex.compile(AGREED)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_str(self.definition)

    @cached_property
    def alphabet(self):
        """Bytes in the model's spelling."""
        from tokenizers import pre_tokenizers
        return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def cut(self, text: str) -> list[str]:
        if self.by_pattern:
            if self.agreed.fullmatch(text):
                return self.pattern.findall(text)
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer else [text]

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """Number of special strings, and of each pre-token."""
        if not self.special or not self.special.search(text):
            return 0, Counter(self.cut(text))
        between = self.special.split(text)
        out: Counter = Counter()
        for piece in between:
            out.update(self.cut(piece) if piece else ())
        return len(between) - 1, out

    def pieces(self, pre_token: str) -> int:
        if not self.by_pattern:
            return len(self.tokenizer.model.tokenize(pre_token))
        return sum(len(self.tokenizer.model.tokenize(p)) for p, _ in self.alphabet.pre_tokenize_str(pre_token))

    def vocabulary(self) -> dict[str, int]:
        """The vocabulary's strings that can be pre-tokens, with their pieces."""
        from tokenizers import decoders
        if not self.by_pattern:
            return {}
        decode = decoders.ByteLevel().decode
        return {s: self.pieces(s) for s in {decode([t]) for t in self.tokenizer.get_vocab(with_added_tokens=False)} if s}


def _scan(sent: Broadcast, part_bytes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, vocabulary = sent.value
        cutter = PreTokens(definition)
        part, size, numbers = TaskContext.get().partitionId() << 32, 0, {}
        kinds = {"bytes": pa.int64(), "known": pa.int64(), "once": NUMBERS, "more": NUMBERS, "times": NUMBERS,
                 "first": pa.int32(), "entries": pa.list_(pa.string())}

        def rows(ids: pa.Array, **given: pa.Array) -> pa.RecordBatch:
            columns = [pa.array([part] * len(ids), pa.int64()), ids, *[given.get(k, pa.nulls(len(ids), v)) for k, v in kinds.items()]]
            return pa.RecordBatch.from_arrays(columns, names=["part", "id", *kinds])

        def dictionary(kind: pa.DataType) -> pa.RecordBatch:
            entries = list(numbers)
            at = range(0, len(entries), ENTRIES)
            return rows(pa.nulls(len(at), kind), first=pa.array(at, pa.int32()),
                        entries=pa.array([entries[i:i + ENTRIES] for i in at], kinds["entries"]))

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            texts, begin, docs = batch.column("text"), 0, []
            for row in range(batch.num_rows):
                text = texts[row].as_py() or ""
                known, found = cutter.frequencies(text)
                once, more = [], []
                for pre_token, n in found.items():
                    pieces = vocabulary.get(pre_token)
                    if pieces is not None:
                        known += pieces * n
                    elif n == 1:
                        once.append(numbers.setdefault(pre_token, len(numbers)))
                    else:
                        more.append((numbers.setdefault(pre_token, len(numbers)), n))
                once = np.sort(np.array(once, np.int32))
                more = np.array(sorted(more), np.int32).reshape(-1, 2)
                length = len(text.encode())
                docs.append((length, known, np.diff(once, prepend=0), np.diff(more[:, 0], prepend=0), more[:, 1]))
                size += length
                full = size >= part_bytes
                if full or len(docs) == DOCS or row + 1 == batch.num_rows:
                    yield rows(batch.column("id").slice(begin, len(docs)),
                               **{k: pa.array(list(v), kinds[k]) for k, v in zip(kinds, zip(*docs))})
                    begin, docs = row + 1, []
                if full:
                    yield dictionary(kind)
                    part, size, numbers = part + 1, 0, {}
        if kind is not None:
            yield dictionary(kind)
    return scan


def _count(sent: Broadcast):
    """Entries come sorted by pre-token: each distinct one is counted once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(sent.value[0])
        last, pieces = None, 0
        for batch in batches:
            out = []
            for entry in batch.column("entry").to_pylist():
                if entry != last:
                    last, pieces = entry, cutter.pieces(entry)
                out.append(pieces)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("number"), pa.array(out, pa.int32())],
                                             names=["part", "number", "pieces"])
    return count


def _sum(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one part and the pieces of its dictionary's entries."""
    pieces = np.zeros(len(counts), np.int64)
    pieces[counts.column("number").to_numpy()] = counts.column("pieces").to_numpy()
    docs = docs.combine_chunks()
    total = docs.column("known").to_numpy().copy()
    for numbers, times in (("once", None), ("more", "times")):
        of = docs.column(numbers).combine_chunks()
        lengths = pa.compute.list_value_length(of).to_numpy()
        ends = np.cumsum(lengths)
        running = np.append(0, np.cumsum(of.flatten().to_numpy(), dtype=np.int64))
        numbered = running[1:] - np.repeat(running[ends - lengths], lengths)
        value = pieces[numbered] * (1 if times is None else docs.column(times).combine_chunks().flatten().to_numpy())
        before = np.append(0, np.cumsum(value))
        total += before[ends] - before[ends - lengths]
    return pa.table({"id": docs.column("id"), "n_bytes": docs.column("bytes"), "n_tokens": pa.array(total, pa.int64())})


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows ``(id, n_bytes, n_tokens, over_limit)``, one per input row.

    ``tokenizer`` is the path of a ``tokenizers`` file; the driver reads it and sends it and the pieces of its
    vocabulary's strings to the tasks (some MB).
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((definition, PreTokens(definition).vocabulary()))
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    parts = written(rows.mapInArrow(_scan(sent, part_bytes), PARTS.format(id=f"id {kind},")), "token-parts")
    entries = parts.filter("entries is not null").select("part", "first", F.posexplode("entries").alias("at", "entry"))
    entries = entries.select("part", (F.col("first") + F.col("at")).alias("number"), "entry")
    counts = (entries.repartition("entry").sortWithinPartitions("entry")
              .mapInArrow(_count(sent), "part long, number int, pieces int"))
    counts = written(counts, "token-pieces")
    out = (parts.filter("entries is null").select("part", "id", "bytes", "known", "once", "more", "times").groupBy("part")
           .cogroup(counts.groupBy("part")).applyInArrow(_sum, f"id {kind}, n_bytes long, n_tokens long"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
