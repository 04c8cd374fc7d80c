"""Near-duplicates by a chosen-path set similarity join (operator 12).

A document is the set of its distinct word shingles (kept as sorted 64-bit hashes); equal sets are one
node from the start. A node has ``TOKENS`` minwise tokens (permutation and minimum). In each of
``trees`` independent trees the nodes branch from the root: a token that the path's hash selects, with
probability ``1 / (threshold * TOKENS)``, leads all nodes that hold it to one child, so a node follows
one path in expectation for every ``threshold`` of its tokens and a pair at the threshold shares one
child in expectation at every level. Branches with at most ``LEAF`` nodes are compared exhaustively;
larger ones branch again. The number of trees follows from the target recall of a pair exactly at
the threshold (``trees_for``).

A larger branch whose members are alike on average is a crowd of near copies, which no token splits. It is dealt
into blocks that share a few anchors.

Comparisons use a 256-bit sketch (two bits a token, 4.5 standard deviations of slack); what it lets
pass is confirmed on the full sets. At first each node names its nearest two in each branch or block, and
the components of the links among the nearest of those are found. Then every branch is compared again, but only
between members of different components (of a crowd: between the members outside its largest one and
all), so that a group of copies costs pairs in proportion to its members and no link between components
is missed. Full sets are made from the texts of candidates only.

Edge cases: null, empty and blank texts have an empty set, are linked with nothing and are their own
component; fewer words than a shingle: the whole sequence is the one shingle; repeated rows and equal
texts share a component; the component is the smallest doc_id in it (null if it has none, ``kept`` then
too); texts of any length are read whole, a slice at a time; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpairs.llm.common import FlatWords, plain, slices
from sparkpairs.llm.components import components
from sparkpairs.session import materialize, scratch_path


WIDTH = 2
PERCENT = 80
TOKENS = 128
RECALL = 0.9999     # of a pair exactly at the threshold, by the depth below
DEPTH = 4           # levels the recall is stated for; deeper trees go on, at a little less
FIRST = 2           # levels branched from one count of sizes to the next
MAX_DEPTH = 12      # a branch still larger than a leaf here is compared in blocks
LEAF = 32
BLOCK = 256
ANCHORS = 16
NEAREST = 2         # candidates that a node names in each of its branches and blocks
CHECKED = 2         # of all those it named, the nearest are checked before components are compared
BROADCAST_IDS = 1 << 20
#: Bytes of text whose sets are held at a time.
SLICE = 2 << 20
#: Sketch places that may differ: those of a similarity of 0.6, 4.5 deviations below 0.8 at 128 tokens.
SLACK = 0.2

#: Sketch places in which the members of a crowd differ from one of them, on average, at most (a similarity of 0.5).
CROWD_PLACES = 48

_A = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.Generator(np.random.PCG64(13)).integers(0, 2**63, TOKENS, dtype=np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Values that a permutation is taken of at a time (they stay in the cache).
CHUNK = 1 << 15


def trees_for(recall: float, depth: int = DEPTH) -> int:
    """Trees after which a pair with one expected common child a level has met with probability ``recall``."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- sets and tokens
def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    import xxhash

    for part in slices(plain(texts), SLICE):
        flat = FlatWords(pc.ascii_lower(part))
        words = np.fromiter(map(xxhash.xxh64_intdigest, flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))[flat.codes]
        off = flat.offsets
        run = mix(words + _K1)
        full = run[:max(0, len(run) - width + 1)].copy()
        for k in range(1, width):
            full = mix(full + words[k:k + len(full)])
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(full[a:b - width + 1])
            elif b > a:
                x = run[a:a + 1]
                for k in range(a + 1, b):
                    x = mix(x + words[k:k + 1])
                yield mix(x + _K2 + np.uint64(b - a))
            else:
                yield run[:0]


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens (16 bits each) of non-empty sets, one row per set."""
    out = np.empty((len(sets), TOKENS), np.uint64)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at:end - 1])])
        for i in range(TOKENS):
            out[at:end, i] = np.minimum.reduceat(values * _A[i] + _B[i], starts)
        at = end
    return (mix(out) & np.uint64(0xFFFF)).astype(np.uint16)


def sketches(tok: np.ndarray) -> np.ndarray:
    """Low and high bit of each token, packed: two 64-bit words of each."""
    bits = np.concatenate([tok & 1, tok >> 1 & 1], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


SKETCH = ["s0", "s1", "s2", "s3"]


def profiles(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, n, digest, tok`` of each row: set size, digest of the set, its tokens (null for an empty set)."""
    import xxhash

    @F.arrow_udf("n bigint, digest string, tok binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            sizes, digests, toks = [], [], []
            pending: list[np.ndarray] = []
            held = 0

            def flush() -> None:
                full = [s for s in pending if len(s)]
                rows = iter(tokens(full)) if full else iter(())
                toks.extend(next(rows).tobytes() if len(s) else None for s in pending)
                pending.clear()

            for s in shingle_sets(arr, width):
                sizes.append(len(s))
                digests.append(xxhash.xxh128_hexdigest(s.tobytes()) if len(s) else None)
                pending.append(s)
                held += len(s)
                if held > 1 << 20:
                    flush()
                    held = 0
            flush()
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(toks, pa.binary())],
                                             ["n", "digest", "tok"])

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("p")).select("id", "p.n", "p.digest", "p.tok")


def _nodes(prof: DataFrame) -> DataFrame:
    """One node per distinct set: ``node, id`` (smallest doc_id)``, n, digest, tok`` and the sketch."""
    one = (prof.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tok").alias("tok"))
           .withColumn("node", F.monotonically_increasing_id()))

    @F.arrow_udf("s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            sk = sketches(_token_rows(arr))
            yield pa.StructArray.from_arrays([pa.array(c) for c in sk.T], SKETCH)

    return materialize(materialize(one).withColumn("s", sketch("tok")).select("node", "id", "n", "digest", "tok", "s.*"))


def _token_rows(arr: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(arr.to_pylist()), np.uint16).reshape(-1, TOKENS)


# ---------------------------------------------------------------- trees
def branches(tok: np.ndarray, paths: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``row, child`` of the tokens that each row's path selects (``paths``: one per row of ``tok``)."""
    place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(16)
    h = mix(paths[:, None] + mix(tok.astype(np.uint64) | place))
    limit = np.uint64(int(2**64 * 100 / (percent * TOKENS)))
    row, col = np.nonzero(h < limit)
    return row, mix(h[row, col] + _K2)


def _roots(nodes: DataFrame, trees: int, percent: int) -> DataFrame:
    """Branches of the first ``FIRST`` levels of all trees (a root holds every node, so its size is no question)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, trees + 1, dtype=np.uint64))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                tok = _token_rows(part.column("tok"))
                of, paths = np.arange(part.num_rows).repeat(trees), np.tile(roots, part.num_rows)
                for _ in range(FIRST):
                    row, paths = branches(tok[of], paths, percent)
                    of = of[row]
                yield _branch_rows(part.column("node"), of, paths)

    return nodes.select("node", "tok").mapInArrow(run, "path bigint, node bigint")


def _deeper(nodes: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The branches ``FIRST`` levels below those of ``live`` (``path, node``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column("paths")
                paths = np.asarray(lists.flatten()).view(np.uint64)
                of = np.arange(part.num_rows).repeat(np.diff(np.asarray(lists.offsets)))
                tok = _token_rows(part.column("tok"))
                for _ in range(FIRST):
                    row, paths = branches(tok[of], paths, percent)
                    of = of[row]
                yield _branch_rows(part.column("node"), of, paths)

    grouped = live.groupBy("node").agg(F.collect_list("path").alias("paths")).withColumnRenamed("node", "of")
    return nodes.select("node", "tok").join(grouped, F.col("node") == F.col("of")).select("node", "tok", "paths") \
        .mapInArrow(run, "path bigint, node bigint")


def _branch_rows(node: pa.Array, of: np.ndarray, paths: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(np.asarray(node)[of])], names=["path", "node"])


def grow(nodes: DataFrame, trees: int, percent: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Small branches (``path, node``) and crowds (``path, node, size``) of all levels."""
    small, crowds = [], []
    children = _roots(nodes, trees, percent)
    for depth in range(FIRST, MAX_DEPTH + 1, FIRST):
        children = scratch.store(children)
        sizes = children.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("path", "p")
        kept = scratch.store(children.join(sizes, F.col("path") == F.col("p")).select("path", "node", "size"))
        scratch.drop(children)
        small.append(kept.where(F.col("size") <= LEAF).select("path", "node"))
        large = kept.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        marked = scratch.store(_with_crowds(nodes, large, depth == MAX_DEPTH))
        crowds.append(marked.where("crowd").select("path", "node", "size"))
        live = marked.where("NOT crowd").select("path", "node", "size")
        if live.isEmpty():
            break
        children = _deeper(nodes, live, percent)
    return small, crowds


def _with_crowds(nodes: DataFrame, large: DataFrame, all_: bool) -> DataFrame:
    """Rows of large branches with whether the branch is a crowd: its members are on average like their first
    (what shares no more than a passage is split by further tokens)."""
    if all_:
        return large.withColumn("crowd", F.lit(True))
    at = nodes.select(F.col("node").alias("of"), *SKETCH)
    first = large.groupBy("path").agg(F.min("node").alias("leader")).withColumnRenamed("path", "p")
    first = first.join(at.select("of", *[F.col(c).alias(f"l{c}") for c in SKETCH]), F.col("leader") == F.col("of")).drop("of", "leader")
    places = sum(F.bit_count(F.col(a).bitwiseXOR(F.col(f"l{a}")).bitwiseOR(F.col(b).bitwiseXOR(F.col(f"l{b}")))) for a, b in (("s0", "s2"), ("s1", "s3")))
    like = (large.join(at, F.col("node") == F.col("of")).join(first, F.col("path") == F.col("p"))
            .groupBy("path").agg(F.avg(places).alias("far")).where(F.col("far") <= CROWD_PLACES).select(F.col("path").alias("q"), F.lit(True).alias("is")))
    return large.join(like, F.col("path") == F.col("q"), "left").select("path", "node", "size", F.coalesce("is", F.lit(False)).alias("crowd"))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished phases, which it does once the driver drops their plans."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables of one run, written as Parquet in the shared folder (smaller than checkpoints, whose rows are
    not compressed) and removed when they are of no more use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, f"chosen-path-{uuid.uuid4().hex}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        self.remove(id(df))

    def remove(self, key: int) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(key))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- comparisons
def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch places in which the rows of ``a`` and those of ``b`` differ."""
    x = a[:, None, :] ^ b[None, :, :]
    return np.bitwise_count(x[..., :2] | x[..., 2:]).sum(-1)


def most_differing(percent: int) -> int:
    """Places that may differ: those of a similarity ``SLACK`` below the threshold."""
    return int(TOKENS * 0.75 * (1 - (percent / 100 - SLACK)))


def _members(b: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    lists = b.column("members")
    off, flat = np.asarray(lists.offsets), lists.values
    cols = {f.name: np.asarray(flat.field(f.name)) for f in flat.type}
    sk = np.stack([cols.pop(c).view(np.uint64) for c in SKETCH], axis=1)
    for path, a, z in zip(b.column("path").to_pylist(), off[:-1], off[1:], strict=True):
        yield {k: v[a:z] for k, v in cols.items()} | {"sketch": sk[a:z], "path": path}


_PAIR = "path bigint, a bigint, b bigint, far bigint"


def _pairs(path: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray], far: list[np.ndarray]) -> pa.RecordBatch:
    p, x, y, d = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in (path, a, b, far)]
    return pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d)],
                                      names=["path", "a", "b", "far"])


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the set sizes alone allow the similarity."""
    return 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])


def _compare(cells: DataFrame, percent: int) -> DataFrame:
    """``path, a, b, far``: each node's nearest candidates inside its cell."""
    limit = most_differing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, a, b, far = [], [], [], []
            for m in _members(batch):
                d = _differing(m["sketch"], m["sketch"]).astype(np.int64)
                ok = (d <= limit) & _fits(m["n"], m["n"], percent)
                np.fill_diagonal(ok, False)
                rank = np.where(ok, d, 1 << 20)
                j = np.argsort(rank, axis=1, kind="stable")[:, :NEAREST]
                i = np.repeat(np.arange(len(d)), j.shape[1])
                j = j.ravel()
                i, j = i[ok[i, j]], j[ok[i, j]]
                a.append(m["node"][i])
                b.append(m["node"][j])
                far.append(d[i, j])
                path.append(np.full(len(i), m["path"]))
            yield _pairs(path, a, b, far)

    return cells.mapInArrow(run, _PAIR)


def _listed(rows: DataFrame, nodes: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Members of each cell with size and sketch."""
    at = nodes.select(F.col("node").alias("of"), "n", *SKETCH)
    full = rows.join(at, F.col("node") == F.col("of"))
    return full.groupBy(*keys).agg(F.collect_list(F.struct("node", "n", *SKETCH, *(extra or []))).alias("members")).select("path", "members").where(F.size("members") > 1)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.min("far").alias("far"))


def in_branches(nodes: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """``path, a, b, far``: the nearest of each node in its small branches."""
    return _compare(_listed(small, nodes, ["path"]), percent)


def in_blocks(nodes: DataFrame, crowds: DataFrame, percent: int) -> DataFrame:
    """``path, a, b, far``: the nearest of each node in the blocks of its crowds."""
    k = F.ceil(F.col("size") / BLOCK)
    u = F.xxhash64("node", "path")
    dealt = crowds.select("path", "node", F.pmod(u, k).alias("block"))
    share = F.shiftrightunsigned(u, 1) / F.lit(float(2**63))
    anchors = crowds.where(share * F.col("size") < ANCHORS).select("path", "node", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)).alias("block"))
    return _compare(_listed(dealt.unionByName(anchors).distinct(), nodes, ["path", "block"]), percent)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    at = labels.select(F.col("node").alias("l"), "component")
    return rows.join(at, F.col("node") == F.col("l"), "left").select("path", "node", F.coalesce("component", "node").alias("label"))


_LISTS = "cell bigint, a array<bigint>, b array<bigint>"


def _lists(a: np.ndarray, b: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Pairs as one row per cell: nodes are dealt into blocks by hash, a cell is a pair of blocks."""
    x, y = np.minimum(a, b), np.maximum(a, b)
    of = [(mix(v.view(np.uint64)) % np.uint64(blocks)).astype(np.int64) for v in (x, y)]
    cell = of[0] * blocks + of[1]
    order = np.argsort(cell, kind="stable")
    cells, starts = np.unique(cell[order], return_index=True)
    off = pa.array([*starts.tolist(), len(order)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *[pa.ListArray.from_arrays(off, pa.array(v[order], pa.int64())) for v in (x, y)]],
                                      names=["cell", "a", "b"])


def between(nodes: DataFrame, small: DataFrame, labels: DataFrame, percent: int, blocks: int) -> DataFrame:
    """Candidates between members of a branch (``small``: those that have a candidate in it) that are in
    different components, listed by cell (``_lists``)."""
    limit = most_differing(percent)
    marked = _labelled(small, labels)
    mixed = marked.groupBy("path").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.col("path").alias("p"))
    rows = marked.join(mixed, F.col("path") == F.col("p"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            a, b = [none], [none]
            for m in _members(batch):
                ok = (_differing(m["sketch"], m["sketch"]) <= limit) & _fits(m["n"], m["n"], percent) & (m["label"][:, None] != m["label"][None, :])
                i, j = np.nonzero(np.triu(ok, 1))
                a.append(m["node"][i])
                b.append(m["node"][j])
            yield _lists(np.concatenate(a), np.concatenate(b), blocks)

    return _listed(rows, nodes, ["path"], ["label"]).mapInArrow(run, _LISTS)


def strangers(nodes: DataFrame, crowds: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidates between the members of a crowd outside its largest component and all its members, listed by
    cell. Crowds with one largest component (those of several trees are much the same) are one."""
    limit = most_differing(percent)
    marked = materialize(_labelled(crowds, labels))
    per = marked.groupBy("path", "label").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("path").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("c")) \
        .where("size > c").select(F.col("path").alias("p"), "main")
    full = materialize(marked.join(main, F.col("path") == F.col("p")).select(F.col("main").alias("path"), "node", "label").distinct())
    parts = full.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("ks"), F.ceil(F.count_if(F.col("label") != F.col("path")) / BLOCK).alias("kr"))
    full = full.join(parts.withColumnRenamed("path", "p"), F.col("path") == F.col("p"))
    zero = F.lit(0).cast("bigint")
    few = full.where("label <> path").withColumn("r", F.pmod(F.xxhash64("node"), "kr")).withColumn("s", F.explode(F.sequence(zero, F.col("ks") - 1)))
    all_ = full.withColumn("s", F.pmod(F.xxhash64("node"), "ks")).withColumn("r", F.explode(F.sequence(zero, F.col("kr") - 1)))
    cols = ["path", "node", "label", "r", "s"]
    rows = few.select(*cols, F.lit(True).alias("few")).unionByName(all_.select(*cols, F.lit(False).alias("few")))
    rows = rows.withColumn("path", F.xxhash64("path", "r", "s")).drop("r", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, a, b = [], [], []
            for m in _members(batch):
                x, y = np.flatnonzero(m["few"]), np.flatnonzero(~m["few"])
                ok = (_differing(m["sketch"][x], m["sketch"][y]) <= limit) & _fits(m["n"][x], m["n"][y], percent)
                i, j = np.nonzero(ok & (m["label"][x][:, None] != m["label"][y][None, :]))
                u, v = m["node"][x[i]], m["node"][y[j]]
                cells.append(m["path"])
                a.append(np.minimum(u, v))
                b.append(np.maximum(u, v))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(a, lists), pa.array(b, lists)], names=["cell", "a", "b"])

    found = _listed(rows, nodes, ["path"], ["label", "few"]).mapInArrow(run, _LISTS)
    return found.where(F.size("a") > 0)


# ---------------------------------------------------------------- full sets
def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``node, hashes`` (sorted, 8 bytes each) of the ``wanted`` nodes, made from the texts of one document each.

    Up to ``BROADCAST_IDS`` nodes are sent to the tasks that read the texts; more are joined by doc_id."""
    import xxhash

    need = materialize(nodes.join(wanted.select(F.col("node").alias("w")), F.col("node") == F.col("w"), "left_semi").select("node", "id", "digest"))
    x = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
    ids = need.where("id IS NOT NULL").select(F.col("id").alias("i")).distinct()
    if need.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = x.join(ids, F.col("doc") == F.col("i"), "left_semi")
    if not need.where("id IS NULL").isEmpty():
        texts = texts.unionByName(x.where("doc IS NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(plain(b.column(0)), SLICE):
                got = [s.tobytes() for s in shingle_sets(part, width)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(xxhash.xxh128_hexdigest, got)), pa.string()), pa.array(got, pa.binary())],
                                                 names=["digest", "hashes"])

    made = texts.select("t").mapInArrow(run, "digest string, hashes binary")
    of = need.select("node", F.col("digest").alias("d"))
    return materialize(made.join(of, F.col("digest") == F.col("d")).groupBy("node").agg(F.first("hashes").alias("hashes")))


#: Bytes of sets that a block of nodes holds on average, at most.
BLOCK_BYTES = 8 << 20


def blocks_of(sets: DataFrame) -> int:
    """Blocks that the nodes are dealt into: of ``BLOCK`` nodes, fewer if their sets are large."""
    n, size = sets.agg(F.count(F.lit(1)), F.sum(F.octet_length("hashes"))).first()
    return max(1, n // BLOCK, (size or 0) // BLOCK_BYTES)


def by_cell(pairs: DataFrame, blocks: int) -> DataFrame:
    """Pairs ``a, b`` listed by cell."""
    x, y = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in ("a", "b"))
    grouped = pairs.groupBy((x * blocks + y).cast("bigint").alias("cell")).agg(F.collect_list(F.struct("a", "b")).alias("p"))
    return grouped.select("cell", F.transform("p", lambda p: p["a"]).alias("a"), F.transform("p", lambda p: p["b"]).alias("b"))


def verify(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose full sets are similar enough.

    A set goes once to each cell that has a pair of its node; a cell holds the sets of two blocks at most."""
    need = lists.select("cell", F.explode(F.array_distinct(F.concat("a", "b"))).alias("of")).distinct()
    none = F.lit(None)
    held = need.join(sets, F.col("of") == F.col("node")).select("cell", F.lit(0).alias("kind"), "node", "hashes",
                                                                none.cast("array<bigint>").alias("a"), none.cast("array<bigint>").alias("b"))
    rows = held.unionByName(lists.select("cell", F.lit(1).alias("kind"), none.cast("bigint").alias("node"), none.cast("binary").alias("hashes"), "a", "b"))
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, found, seen = None, {}, set()
        for b in batches:
            out: list[tuple[int, int]] = []
            kinds, cells = b.column("kind").to_pylist(), b.column("cell").to_pylist()
            for i, (kind, c) in enumerate(zip(kinds, cells, strict=True)):
                if c != cell:
                    cell, found, seen = c, {}, set()
                if kind == 0:
                    found[b.column("node")[i].as_py()] = np.frombuffer(b.column("hashes")[i].as_py(), np.uint64)
                    continue
                for x, y in set(zip(b.column("a")[i].as_py(), b.column("b")[i].as_py(), strict=True)) - seen:
                    seen.add((x, y))
                    u, v = found[x], found[y]
                    both = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                    if 100 * both >= percent * (len(u) + len(v) - both):
                        out.append((x, y))
            a, z = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return rows.repartition(n, "cell").sortWithinPartitions("cell", "kind").mapInArrow(run, "a bigint, b bigint")


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Each node's ``k`` nearest candidates (it has a few in each of its branches)."""
    both = pairs.select("a", "b", "far").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    best = both.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "b"))), 1, k).alias("best"))
    best = best.select("a", F.explode("best.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---------------------------------------------------------------- the operator
def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
         recall: float = RECALL) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row."""
    prof = materialize(profiles(docs, id_col, text_col, width))
    nodes = _nodes(prof)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    branches_, crowded = grow(nodes, trees_for(recall), percent, scratch)
    small = _union(branches_)
    crowds = materialize(_union(crowded)) if crowded else None
    if crowds is not None and crowds.isEmpty():
        crowds = None
    found = scratch.store(in_branches(nodes, small, percent))
    every = materialize(_distinct(found if crowds is None else found.unionByName(in_blocks(nodes, crowds, percent))))
    ends = [every.select(F.col(c).alias("node")) for c in ("a", "b")] + ([crowds.select("node")] if crowds is not None else [])
    # whatever may be compared later has a candidate now: it is the nearest of its branch to some member
    sets = full_sets(docs, nodes, _union(ends).distinct(), id_col, text_col, width)
    blocks = blocks_of(sets)
    release(spark)
    links = materialize(verify(by_cell(_nearest(every, CHECKED), blocks), sets, percent))
    labels = materialize(components(links))
    release(spark)
    # what has no candidate in a branch has none there later either
    active = found.select("path", F.explode(F.array("a", "b")).alias("node")).distinct()
    more = between(nodes, active, labels, percent, blocks)
    if crowds is not None:
        more = more.unionByName(strangers(nodes, crowds, labels, percent))
    links = materialize(links.unionByName(verify(scratch.store(more), sets, percent)))
    for table in [*scratch.paths]:
        scratch.remove(table)
    release(spark)
    return _result(prof, nodes, components(links), id_col)


def _result(prof: DataFrame, nodes: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    at = labels.select(F.col("node").alias("l"), "component")
    rooted = materialize(nodes.select("node", "id", "digest").join(at, F.col("node") == F.col("l"), "left")
                         .select("digest", F.col("id").alias("least"), F.coalesce("component", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    of = rooted.join(least, F.col("root") == F.col("r")).select(F.col("digest").alias("d"), "component_id")
    out = prof.select("id", "n", "digest").join(of, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("id") == component).alias("kept"))
