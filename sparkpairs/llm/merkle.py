"""Merkle manifest of a table by time-forward processing (operator 11).

Every row is a leaf: the digest of its length-prefixed fields. The rows of a group, in order, are the
leaves of a tree of fan-out 16; the roots of the groups are the leaves of one more tree.

Forward: nodes carry labels (level, index) and are worked on in the order of their labels; a node sends
its digest to its parent through a priority queue ordered by label. In a task the queue holds one
block of ``BLOCK`` consecutive nodes; digests that leave a block are messages of the next layer, and
Spark's sorted shuffle by (group, block, position) is the queue's external part. A table of n rows
takes log(n) / log(BLOCK) layers. Reversed: labels are worked on downwards; a node sends each child what
its proof ends with (the siblings beside and above the node), so a leaf's proof is its own run's siblings
and the suffix it received. Suffixes of a block arrive as one message that sorts before its nodes.

Skew: positions come from range partitions (``ordered``), blocks have a bounded number of rows, and
text never leaves the task that reads it (only digests are shuffled), so one group may hold all rows.

Edge cases: null fields are ``-``, so null and empty differ; a null group is a group and comes first; rows
without id come first in their group; rows of one id follow each other by digest; a lone leaf is the
root of its group, a lone group's root the root; texts of any length are digested whole; an empty
table gives an empty result; other columns do not matter (``proofs`` returns columns of its own).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpairs.llm.ordered import numbered
from sparkpairs.session import materialize

FAN = 16
#: Levels worked on inside a block, and its number of nodes.
LEVELS = 3
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "g string, pos bigint, n bigint, digest string"


def node_digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of the fields, each as its UTF-8 length, a colon and its value, ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(rows: DataFrame, altered: dict[str, Column] | None = None, group_col: str = "source", id_col: str = "doc_id",
           fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``g, id, digest, other``: a leaf per row. ``other`` is the digest of the row with the columns that
    ``altered`` names replaced: what a later copy of the table is checked with."""
    altered = altered or {}
    same = F.lit(True)
    for c, new in altered.items():
        same = same & F.col(c).eqNullSafe(new)
    x = rows.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
                    F.when(~same, leaf_digest([altered.get(c, F.col(c)) for c in fields])).alias("other"))
    return x.withColumn("other", F.coalesce("other", "digest"))


# ---------------------------------------------------------------- in a task
def height(n: int) -> int:
    """Levels above the ``n`` nodes of a group inside one block."""
    if n > BLOCK:
        return LEVELS
    levels = 0
    while n > 1:
        n = -(-n // FAN)
        levels += 1
    return levels


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of all nodes of a block by level, children before parents."""
    nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    queue = [(0, i, 0, d) for i, d in enumerate(digests)]  # (level, index, child slot, digest), sorted already
    while queue:
        level, index, _, first = heapq.heappop(queue)
        inbox = [first]
        while queue and queue[0][0] == level and queue[0][1] == index:
            inbox.append(heapq.heappop(queue)[3])
        digest = node_digest(inbox) if level else first
        nodes[level].append(digest)
        if level < levels:
            heapq.heappush(queue, (level + 1, index // FAN, index % FAN, digest))
    return nodes


def reversed_sweep(nodes: list[list[str]], suffix: list[str]) -> Iterator[tuple[int, list[str]]]:
    """``index, path`` of each node of the lowest level, last first. A path lists what stands left and
    right of the node in its run, then of its parent, and so on up to the root."""
    top = len(nodes) - 1
    queue: list[tuple[int, int, list[str]]] = [(-top, 0, suffix)]
    while queue:
        level, index, path = heapq.heappop(queue)
        level, index = -level, -index
        if level == 0:
            yield index, path
            continue
        run = nodes[level - 1][index * FAN:(index + 1) * FAN]
        for slot in range(len(run)):
            own = ["".join(run[:slot]), "".join(run[slot + 1:]), *path]
            heapq.heappush(queue, (1 - level, -(index * FAN + slot), own))


def fold(digest: str, path: list[str]) -> str:
    """Root that a leaf's digest and its path lead to."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = node_digest([left, digest, right])
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (group, block) after the other, from sorted rows."""
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if rows and (rows[0]["g"], rows[0]["block"]) != (r["g"], r["block"]):
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


# ---------------------------------------------------------------- layers
def _queue(rows: DataFrame) -> DataFrame:
    """Nodes and messages in the order of their labels, a block in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g", "block").sortWithinPartitions("g", "block", "pos")


def _with_block(layer: DataFrame) -> DataFrame:
    return layer.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint"))


def _tops(layer: DataFrame) -> DataFrame:
    """``g, pos, n, digest`` of the node above each block (``pos`` is the block, ``n`` that of the layer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _blocks(batches):
            n = rows[0]["n"]
            top = forward([r["digest"] for r in rows], height(n))[-1][0]
            out.append((rows[0]["g"], rows[0]["block"], n, top))
            if len(out) == 1000:
                yield _batch(out, ["g", "pos", "n", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()])
                out = []
        yield _batch(out, ["g", "pos", "n", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()])

    return _queue(_with_block(layer.select("g", "pos", "n", "digest"))).mapInArrow(run, _NODE)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def build(layer0: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Layers of nodes from ``g, pos, n, digest`` leaves, and ``g, digest, layer``: each group's root and
    the layer whose only block it stands above."""
    n = layer0.agg(F.max("n")).first()[0] or 1
    layers, roots = [layer0], None
    while True:
        tops = materialize(_tops(layers[-1]))
        done = tops.where(F.col("n") <= BLOCK).select("g", "digest", F.lit(len(layers) - 1).cast("bigint").alias("layer"))
        roots = done if roots is None else roots.unionAll(done)
        if n <= BLOCK:
            return layers, roots
        n = -(-n // BLOCK)
        layers.append(tops.where(F.col("n") > BLOCK).withColumn("n", F.ceil(F.col("n") / BLOCK).cast("bigint")))


_MESSAGE = "g string, block bigint, suffix array<string>, subroot string, root string"


def _deliver(layer: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes of a layer behind the message of their block."""
    m = messages.select("g", "block", F.lit(-1).cast("bigint").alias("pos"), "suffix", "subroot", "root")
    return _queue(_with_block(layer).unionByName(m, allowMissingColumns=True))


def _suffixes(layer: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of an upper layer to the blocks below it: one per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
        for m, *rows in _blocks(batches):
            nodes = forward([r["digest"] for r in rows], height(rows[0]["n"]))
            out = [(m["g"], rows[i]["pos"], path, m["subroot"], m["root"]) for i, path in reversed_sweep(nodes, m["suffix"])]
            for at in range(0, len(out), 500):
                yield _batch(out[at:at + 500], ["g", "block", "suffix", "subroot", "root"], types)

    return _deliver(layer.select("g", "pos", "n", "digest"), messages).mapInArrow(run, _MESSAGE)


def descend(layers: list[DataFrame], messages: DataFrame) -> DataFrame:
    """Messages to the blocks of the lowest layer. ``messages``: those of ``_MESSAGE`` from above, with their ``layer``."""
    for k in range(len(layers) - 1, 0, -1):
        here = messages.where(F.col("layer") == k).drop("layer")
        below = materialize(_suffixes(layers[k], here)).withColumn("layer", F.lit(k - 1).cast("bigint"))
        messages = messages.where(F.col("layer") < k).unionByName(below)
    return messages.drop("layer")


# ---------------------------------------------------------------- the manifest
def _leaf_layer(rows: DataFrame, order: list[Column]) -> DataFrame:
    return materialize(numbered(rows, order, "pos", group="g", size="n"))


def proofs(rows: DataFrame, altered: dict[str, Column] | None = None, group_col: str = "source", id_col: str = "doc_id",
           fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    The proof is that of the table as it is; ``folded_root`` is what it gives with the row as ``altered``."""
    own = materialize(leaves(rows, altered, group_col, id_col, fields))
    layer0 = _leaf_layer(own, [F.asc_nulls_first("g"), F.asc_nulls_first("id"), F.asc("digest"), F.asc("other")])
    layers, subroots = build(layer0)
    # the roots of the groups are the leaves of one more tree, whose only group is null
    tops = materialize(subroots.select(F.lit(None).cast("string").alias("g"), F.col("g").alias("of"), "digest", "layer"))
    top0 = _leaf_layer(tops, [F.asc_nulls_first("g"), F.asc_nulls_first("of")])
    top_layers, root = build(top0.select("g", "pos", "n", "digest"))
    first = root.select("g", F.lit(0).cast("bigint").alias("block"), F.array().cast("array<string>").alias("suffix"),
                        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), "layer")
    to_groups = _group_messages(top0, descend(top_layers, first))
    return _leaf_proofs(layer0, descend(layers, materialize(to_groups)), own.schema["id"].dataType.simpleString())


def _group_messages(top0: DataFrame, messages: DataFrame) -> DataFrame:
    """A message to the highest block of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64()]
        for m, *rows in _blocks(batches):
            nodes = forward([r["digest"] for r in rows], height(rows[0]["n"]))
            out = [(rows[i]["of"], 0, path, rows[i]["digest"], m["root"], rows[i]["layer"])
                   for i, path in reversed_sweep(nodes, m["suffix"])]
            for at in range(0, len(out), 500):
                yield _batch(out[at:at + 500], ["g", "block", "suffix", "subroot", "root", "layer"], types)

    return _deliver(top0, messages).mapInArrow(run, f"{_MESSAGE}, layer bigint")


def _leaf_proofs(layer0: DataFrame, messages: DataFrame, id_type: str) -> DataFrame:
    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        types = [pa.string()] * 5 + [pa.bool_()]
        for m, *rows in _blocks(batches):
            nodes = forward([r["digest"] for r in rows], height(rows[0]["n"]))
            out, ids = [], []
            for i, path in reversed_sweep(nodes, m["suffix"]):
                r = rows[i]
                folded = fold(r["other"], path)
                ids.append(r["id"])
                out.append((r["digest"], m["subroot"], m["root"], node_digest(path), folded, folded == m["root"]))
            b = _batch(out, names, types)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), *b.columns], names=["id", *names])

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(layer0.schema["id"].dataType)
    return _deliver(layer0.select("g", "pos", "n", "digest", "id", "other"), messages).mapInArrow(run, schema)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())
