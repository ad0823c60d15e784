"""Semi-join reduction: keep wide rows out of a shuffle that only a few of them need.

``df.join(wanted, key)`` moves every row of ``df`` with all its columns when ``wanted`` is too large to
broadcast.  ``may_match`` first keeps the rows whose key may be wanted, by a bit set of the wanted
keys' hashes.  The bit set is a table of at most ``MAX_BITS / 64`` words whatever the
data are, so its broadcast has a fixed bound; the join that follows is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table

#: Wanted keys up to this size are broadcast themselves (bytes, with 16 for each key).
MAX_KEY_BYTES = 16 << 20

#: 2 ** 20 words of 64 bits.
MAX_BITS = 1 << 26
BITS_PER_KEY = 16


def _place(key: str, bits: int) -> tuple[Column, Column]:
    """The word of a key's bit, and that word with only this bit set."""
    at = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(bits))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def may_match(df: DataFrame, wanted: DataFrame, key: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``wanted`` (a column of the same name), and a few others.

    Of the others about one in ``BITS_PER_KEY`` stays while the wanted keys fit the bit set; beyond
    that more stay, and none that is wanted is lost.  Rows with a null key go, as they match nothing.
    ``wanted`` is read twice; write it as a table where it is costly.
    """
    keys = wanted.where(F.col(key).isNotNull()).select(key)
    bits = min(max(1 << (keys.count() * BITS_PER_KEY).bit_length(), 64), max_bits)
    word, bit = _place(key, bits)
    words = keys.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    word, bit = _place(key, bits)
    return df.where(F.col(key).isNotNull()).join(
        F.broadcast(words), (word == F.col("__word")) & (bit.bitwiseAND(F.col("__bits")) != 0), "left_semi")


def rows_of(df: DataFrame, wanted: DataFrame, key: str, max_bytes: int = MAX_KEY_BYTES) -> DataFrame:
    """The left semi join of ``df`` with derived keys, without a shuffle of unwanted rows.

    The keys are computed once, as a table.  Up to ``max_bytes`` they are broadcast, so a hot key's rows stay
    where they are; beyond that ``may_match`` filters ``df`` in the scan and the join is left to the planner.
    """
    keys = written_table(wanted.where(F.col(key).isNotNull()).select(key).distinct(), "wanted")
    size = keys.agg(F.coalesce(F.sum(F.octet_length(F.col(key).cast("string")) + 16), F.lit(0))).first()[0]
    if size <= max_bytes:
        return df.join(F.broadcast(keys), key, "left_semi")
    return may_match(df, keys, key).join(keys, key, "left_semi")
