"""Merkle manifest of a dataset: a 16-ary hash tree per source, and one over the sources.

Postorder append log.  A tree's nodes are written by aligned builders: the builder of level L and
block b owns the ``SPAN = 16^3`` consecutive nodes of level L that start at ``b * SPAN``, which
are whole subtrees.  It appends each node as soon as the node is complete: leaves in order, and a
parent right after its last child, which is postorder.  The place of any node in the builder's log
then follows from subtree sizes alone (``log_position``), so a proof reads its siblings by
address and stores no pointers.  The roots of a tree's builders are the nodes of level L + 3, for
which the next builders run, until one node is left.  What the trees of all sources come to
is the bottom of one further tree.

Proofs go the other way: a builder whose own root has a proof gives one to each of its
bottom nodes, which are the roots of the builders below.

On Spark: digests are taken in the scan, so texts are read once and never shuffled.  Rows are put in
order by a range exchange on (source, id, digest, row number), numbered inside their partition and
shifted by the counts of the partitions before, so a source with a third of all rows is spread like
any other.  A builder is a group of at most ``SPAN`` rows of fixed width.  The driver learns one number a
level, the size of the largest tree.

Defined cases: a null field hashes as ``-``, an empty one as ``0:``; a null id comes before all
others and a null source is a source of its own, before all others; rows that repeat an id are
leaves of their own, in order of their digests (equal rows have equal digests, each has its own
place and proof); an empty table gives no rows and no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import only, written

FAN, LEVELS = 16, 3
SPAN = FAN ** LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One row a builder: its nodes in order of completion, 32 bytes each.
LOG = "tree string, level int, block long, total long, leaves long, height int, log binary, root binary"
STEP = "array<struct<left: string, right: string>>"


def height_of(total: int, fan: int = FAN) -> int:
    """Levels above the leaves of a tree that has ``total`` of them."""
    height = 0
    while total > 1:
        total, height = -(-total // fan), height + 1
    return height


def log_position(level: int, index: np.ndarray | int, leaves: int, height: int, fan: int = FAN) -> np.ndarray:
    """Place of node ``index`` of ``level`` in the postorder log of a tree of ``leaves`` and ``height``.

    A full node completes with leaf ``end``: before it stand all full nodes of its level and
    below that end by then, and those above that ended earlier.  The last node of a level may
    be cut short by the tree's end; these come after all full ones, from the lowest up.
    """
    index = np.asarray(index, dtype=np.int64)
    end = (index + 1) * fan ** level
    place = sum(end // fan ** k for k in range(level + 1)) + sum((end - 1) // fan ** k for k in range(level + 1, height + 1)) - 1
    cut = sum(leaves // fan ** k for k in range(height + 1)) + sum(leaves % fan ** k != 0 for k in range(1, level))
    return np.where(end <= leaves, place, cut)


def _sizes(leaves: int, height: int) -> list[int]:
    return [-(-leaves // FAN ** level) for level in range(height + 1)]


def _combined(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def append_log(leaves: Sequence[bytes], height: int) -> list[bytes]:
    """Nodes in order of completion."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(height + 1)]

    def add(digest: bytes, level: int) -> None:
        log.append(digest)
        if level < height:
            open_runs[level].append(digest)
            if len(open_runs[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        add(_combined(run), level + 1)
    for leaf in leaves:
        add(leaf, 0)
    for level in range(height):
        if open_runs[level]:
            close(level)
    return log


def _build(level: int):
    def build(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        total = nodes.column("total")[0].as_py()
        height = min(LEVELS, height_of(total))
        log = append_log(nodes.column("digest").to_pylist(), height)
        return pa.table({"tree": nodes.column("tree")[:1].combine_chunks(), "level": pa.array([level], pa.int32()),
                         "block": nodes.column("block")[:1].combine_chunks(), "total": pa.array([total], pa.int64()),
                         "leaves": pa.array([len(nodes)], pa.int64()), "height": pa.array([height], pa.int32()),
                         "log": pa.array([b"".join(log)], pa.binary()), "root": pa.array([log[-1]], pa.binary())})
    return build


def build_trees(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes(tree, idx, digest, total)`` -> the builders' logs, one table per three levels."""
    rounds: list[DataFrame] = []
    while True:
        block = F.floor(F.col("idx") / SPAN).alias("block")
        built = written(nodes.select("tree", block, "idx", "digest", "total").groupBy("tree", "block")
                        .applyInArrow(_build(LEVELS * len(rounds)), LOG), f"{name}-{len(rounds)}")
        rounds.append(built)
        largest = built.agg(F.max("total")).first()[0]
        if (largest or 0) <= SPAN:
            return rounds
        nodes = (built.filter(F.col("total") > SPAN)
                 .select("tree", F.col("block").alias("idx"), F.col("root").alias("digest"),
                         F.ceil(F.col("total") / SPAN).alias("total")))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``(tree, root)``: each tree ends in the round in which one builder holds all of it."""
    out = None
    for built in rounds:
        last = built.filter(F.col("total") <= SPAN).select("tree", "root")
        out = last if out is None else out.unionByName(last)
    return out


def _steps(row: dict) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """For each bottom node of a builder: the siblings to its left and right, level by level."""
    log, leaves, height = row["log"], row["leaves"], row["height"]
    runs: list[dict[int, list[str]]] = []
    for level, size in enumerate(_sizes(leaves, height)[:-1]):
        at = log_position(level, np.arange(size), leaves, height) * 32
        runs.append({})
        for start in range(0, size, FAN):
            runs[level][start // FAN] = [log[a:a + 32].hex() for a in at[start:start + FAN].tolist()]
    pairs = [{run * FAN + k: ("".join(of[:k]), "".join(of[k + 1:])) for run, of in level.items() for k in range(len(of))}
             for level in runs]
    for leaf in range(leaves):
        yield leaf, [pairs[level][leaf // FAN ** level] for level in range(height)]


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builders with the proofs of their roots -> proofs of their bottom nodes."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for batch in batches:
        for row in batch.to_pylist():
            above = [(s["left"], s["right"]) for s in row["above"]]
            first = row["block"] * SPAN
            index, paths = [], []
            for leaf, steps in _steps(row):
                index.append(first + leaf)
                paths.append([{"left": a, "right": b} for a, b in steps + above])
            yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(index), pa.string()), pa.array(index, pa.int64()),
                                              pa.array(paths, kind)], names=["tree", "idx", "above"])


PROVED = f"tree string, idx long, above {STEP}"


def prove_down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tops(tree, above)``, the proofs of the trees' roots -> the lowest builders ``LOG`` with
    the proof of each builder's root as ``above``."""
    below = None
    for built in reversed(rounds):
        ends = built.filter(F.col("total") <= SPAN).join(tops, "tree")
        if below is None:
            proved = ends
        else:
            inner = below.select("tree", F.col("idx").alias("block"), "above")
            proved = ends.unionByName(built.filter(F.col("total") > SPAN).join(inner, ["tree", "block"]), allowMissingColumns=True)
        if built is rounds[0]:
            return proved
        below = proved.mapInArrow(_prove, PROVED)


def numbered(rows: DataFrame, tree: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``idx``, the place of a row in its tree in the given order, and the tree's ``total``.

    ``rows`` is a written table; ``order`` ends in a column that tells all rows apart.
    """
    parts = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    parts = parts.withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(tree).to_pylist()
            at = []
            for value in names:
                seen = seen + 1 if value == last else 0
                last = value
                at.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "nth"])
    schema = StructType([*parts.schema.fields, StructField("nth", LongType())])
    parts = written(parts.mapInArrow(number, schema), name)
    counts = parts.groupBy(tree, "part").count()
    window = Window.partitionBy(tree).orderBy("part")
    starts = counts.select(tree, "part", (F.sum("count").over(window) - F.col("count")).alias("base"),
                           F.sum("count").over(Window.partitionBy(tree)).alias("total"))
    return parts.join(starts, [tree, "part"]).withColumn("idx", F.col("base") + F.col("nth")).drop("part", "nth", "base")


def _fold(digest: str, steps: Sequence[tuple[str, str]]) -> str:
    for left, right in steps:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def _verify(leaves: pa.Table, builders: pa.Table) -> pa.Table:
    """The leaves of one builder: their proofs, and what ``held`` folds to with them."""
    row = builders.to_pylist()[0]
    above = [(s["left"], s["right"]) for s in row["above"]]
    tail = "".join(left + right for left, right in above)
    leaves = leaves.sort_by("idx")
    held = leaves.column("held").to_pylist()
    tops: dict[str, str] = {}  # root of this builder as folded -> root of all as folded from there
    proofs, folded = [], []
    for leaf, steps in _steps(row):
        proofs.append(hashlib.sha256(("".join(a + b for a, b in steps) + tail).encode()).hexdigest())
        digest = _fold(held[leaf].hex(), steps)
        if digest not in tops:
            tops[digest] = _fold(digest, above)
        folded.append(tops[digest])
    return pa.table({"id": leaves.column("id"), "leaf": pa.array([d.hex() for d in leaves.column("digest").to_pylist()], pa.string()),
                     "subroot": pa.array([row["subroot"].hex()] * len(leaves), pa.string()),
                     "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})


def field(column: Column) -> Column:
    """One field as it enters a leaf."""
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def tree_key(source: Column) -> Column:
    """A non-null name of the source's tree, in the order of the sources, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def manifest(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", source_col: str = "source",
             held: Column | None = None) -> DataFrame:
    """Rows ``(id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one per input row.

    ``columns`` are what a leaf hashes, in order.  ``held`` is the digest that is checked against
    the manifest (the leaf's own if not given).
    """
    digest = leaf_digest(*[F.col(f"`{c}`") for c in columns])
    leaves = docs.select(F.col(f"`{id_col}`").alias("id"), tree_key(F.col(f"`{source_col}`")).alias("tree"),
                         digest.alias("digest"), (digest if held is None else held).alias("held"),
                         F.monotonically_increasing_id().alias("row"))
    leaves = numbered(written(leaves, "leaves"), "tree", ["id", "digest", "row"], "leaf-places")
    leaves = leaves.withColumn("block", F.floor(F.col("idx") / SPAN))

    trees = build_trees(leaves, "trees")
    subroots = written(roots(trees), "subroots")
    places = numbered(subroots.withColumn("whole", F.lit("")), "whole", ["tree"], "tree-places")
    top = build_trees(places.select(F.col("whole").alias("tree"), "idx", F.col("root").alias("digest"), "total"), "top")
    last = roots(top).first()  # one digest
    root = last["root"].hex() if last else None

    none = F.array().cast(STEP)
    proved = prove_down(top, roots(top).select("tree", none.alias("above"))).mapInArrow(_prove, PROVED)
    tops = places.select("tree", "idx").join(proved.select("idx", "above"), "idx").select("tree", "above")
    lowest = prove_down(trees, tops).join(subroots.select("tree", F.col("root").alias("subroot")), "tree")
    kind = docs.schema[id_col].dataType.simpleString()
    out = (leaves.groupBy("tree", "block").cogroup(lowest.groupBy("tree", "block"))
           .applyInArrow(_verify, f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"))
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.lit(root)).alias("verified"))
