"""SimHash near-duplicates by a byte-position inverted index (operator 5).

Texts become 64-bit fingerprints; fingerprints at ``max_bits`` (4) or fewer
differing bits are linked. Four differing bits touch at most four of the eight
bytes, so linked fingerprints share at least four positional bytes (the count
filter). A list per single byte would hold a 256th of all rows, so the index
keeps the twenty byte-position triples of a Turan design, of which any four
shared bytes contain one. Within a list the shared positional bytes of a pair
are tallied, pairs below four are dropped, and the rest is verified bit by bit.

Equal fingerprints are grouped first, so a group of copies is one entry. Lists
longer than ``BLOCK`` are dealt out as pairs of blocks to many tasks. A cell
never emits its pairs, but the edges of a spanning forest of its links (each
link looked at in the first list that both fingerprints share), so a large
group of near copies costs edges in proportion to its members and loses no
link: the result is the component of each row.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; repeated rows are linked to each other; fingerprints are the nodes, so
rows without doc_id link like others; the component is the smallest doc_id in it,
null if no row has one; an empty table gives an empty result; other columns are ignored
(``fingerprints``, ``link``) or carried (``drop_near_duplicates``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpairs.llm.common import free_name, plain, slices
from sparkpairs.llm.components import components
from sparkpairs.session import materialize

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCK = 1024
#: Two shared bytes fall together into one of three byte groups whenever four are shared;
#: with a third byte from the same or the next group they form one of these triples.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def turan_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions contain one of them:
    those inside a group, and those with two positions in a group and one in the next."""
    where = {p: g for g, ps in enumerate(GROUPS) for p in ps}
    out = []
    for t in combinations(range(8), 3):
        g = sorted(where[p] for p in t)
        two = max(g, key=g.count)
        other = next((x for x in g if x != two), None)
        if other is None or (g.count(two) == 2 and other == (two + 1) % 3):
            out.append(t)
    return out


TRIPLES = turan_triples()
#: First triple contained in each set of shared bytes (as a bit mask), -1 if none.
FIRST = np.array([next((i for i, t in enumerate(TRIPLES) if all(m >> p & 1 for p in t)), -1) for m in range(256)])


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles (repeats included) of a text."""
    from functools import partial

    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, split at space and \t \n \v \f \r
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) <= width:
        return digest(b" ".join(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a part at a time: texts may be very long
        m = min(1 << 16, n - at)
        part = zip(*(words[at + k:at + k + m] for k in range(width)), strict=True)
        h = np.fromiter(map(digest, map(b" ".join, part)), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = SHINGLE, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer in ``out``."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            got = [fingerprint(t, width) for part in slices(plain(arr)) for t in part.cast(pa.large_binary()).to_pylist()]
            yield pa.array(np.array(got, np.uint64).view(np.int64))

    return docs.withColumn(out, run(F.col(text_col)))


# ---------------------------------------------------------------- links
def _forest(fps: np.ndarray, ids: np.ndarray, side: np.ndarray, triple: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links of one cell (across sides if it has two)."""
    x = fps[:, None] ^ fps[None, :]
    mask = np.zeros(x.shape, np.uint8)
    for p in range(8):
        mask |= (((x >> np.uint64(8 * p)) & np.uint64(255)) == 0).astype(np.uint8) << np.uint8(p)
    link = (np.bitwise_count(mask) >= 4) & (FIRST[mask] == triple) & (np.bitwise_count(x) <= max_bits)
    if side.any():
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, True)
    label = np.arange(len(fps))
    while True:
        least = np.where(link, label[None, :], len(fps)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    child = np.flatnonzero(label != np.arange(len(fps)))
    return ids[child], ids[label[child]]


def _cells(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = b.column("members")
            off = np.asarray(members.offsets)
            flat = members.values
            fps = np.asarray(flat.field("fp")).view(np.uint64)
            ids, side = np.asarray(flat.field("id")), np.asarray(flat.field("side"))
            triple = np.asarray(b.column("triple"))
            left, right = [], []
            n = np.diff(off)
            # most lists hold two fingerprints: verified together
            two = np.flatnonzero(n == 2)
            i = off[:-1][two]
            x = fps[i] ^ fps[i + 1]
            mask = np.zeros(len(x), np.uint8)
            for p in range(8):
                mask |= (((x >> np.uint64(8 * p)) & np.uint64(255)) == 0).astype(np.uint8) << np.uint8(p)
            ok = (np.bitwise_count(mask) >= 4) & (FIRST[mask] == triple[two]) & (np.bitwise_count(x) <= max_bits)
            left.append(ids[i[ok]])
            right.append(ids[i[ok] + 1])
            for c in np.flatnonzero(n > 2):
                s = slice(off[c], off[c + 1])
                a, z = _forest(fps[s], ids[s], side[s], int(triple[c]), max_bits)
                left.append(a)
                right.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
    return run


def links(reps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` (ids) that connect what is within ``max_bits`` of each other.

    ``reps``: distinct fingerprints ``fp`` with an ``id`` each."""
    if max_bits > 4:
        raise ValueError("the byte-position index guarantees shared bytes up to 4 differing bits")

    def key(i, t):
        bytes_ = [F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255), 8 * k) for k, p in enumerate(t)]
        return F.struct(F.lit(i).alias("triple"), (bytes_[0].bitwiseOR(bytes_[1]).bitwiseOR(bytes_[2])).alias("bytes"))

    postings = reps.select("fp", "id", F.explode(F.array(*[key(i, t) for i, t in enumerate(TRIPLES)])).alias("k")) \
        .select("fp", "id", "k.triple", "k.bytes")
    sizes = postings.groupBy("triple", "bytes").agg(F.count("*").alias("n")).where("n > 1") \
        .select(F.col("triple").alias("t"), F.col("bytes").alias("y"), "n")
    listed = postings.join(sizes, (F.col("triple") == F.col("t")) & (F.col("bytes") == F.col("y")))
    k = F.ceil(F.col("n") / block)
    r = F.pmod(F.xxhash64("fp", F.lit(7)), k)
    cells = (listed.withColumn("k", k).withColumn("r", r)
             .select("triple", "bytes", "fp", "id", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("s"))
             .select("triple", "bytes", F.least("r", "s").alias("lo"), F.greatest("r", "s").alias("hi"),
                     F.struct("fp", "id", (F.col("r") > F.col("s")).alias("side")).alias("m")))
    grouped = cells.groupBy("triple", "bytes", "lo", "hi").agg(F.collect_list("m").alias("members")).where(F.size("members") > 1)
    return grouped.select("triple", "members").mapInArrow(_cells(max_bits), "a bigint, b bigint").distinct()


def _fingerprint_components(fps: DataFrame, max_bits: int) -> DataFrame:
    """``rep_fp, root, component_id`` of each fingerprint: the component's smallest fingerprint and doc_id."""
    reps = materialize(fps.groupBy("fp").agg(F.min("id").alias("id")))
    comp = components(links(reps.select("fp", F.col("fp").alias("id")), max_bits))
    rooted = materialize(reps.join(comp, reps["fp"] == comp["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id")).select(F.col("root").alias("_root"), "component_id")
    return rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("rep_fp"), "root", "component_id")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
         max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col, fingerprint`` (signed 64-bit), ``component_id`` of every row."""
    return _link(docs, id_col, text_col, width, max_bits)[0]


def _link(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``link`` and the components of the fingerprints."""
    fps = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", width, "fp").drop("t"))
    of_fp = materialize(_fingerprint_components(fps, max_bits))
    return fps.join(of_fp, F.col("fp") == F.col("rep_fp")).select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id"), of_fp


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component (that of the smallest doc_id), with exactly the columns of ``docs``.

    Rows without doc_id or with one that others share are told apart by their text: of those that
    stand for a component the one with the smallest text hash stays."""
    row, gone_id, fp = free_name(docs, "_row"), free_name(docs, "_gone"), free_name(docs, "_fp")
    linked, of_fp = _link(docs, "doc_id", "text", width, max_bits)
    comp = materialize(linked)
    gone = comp.where("doc_id != component_id").select(F.col("doc_id").alias(gone_id))
    again = comp.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(gone_id))
    again = materialize(again)
    if again.isEmpty():  # ids are unique, as a rule: no text is grouped
        return docs.join(gone.distinct(), F.col("doc_id") == F.col(gone_id), "left_anti")
    kept = docs.where("doc_id IS NOT NULL").join(gone.unionAll(again).distinct(), F.col("doc_id") == F.col(gone_id), "left_anti")
    shared = docs.join(again, F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_semi")
    marked = fingerprints(shared, "text", width, fp).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(fp).alias("f"))
    one = (marked.join(of_fp, F.col("f") == F.col("rep_fp")).where(F.col("r.doc_id").eqNullSafe(F.col("component_id")))
           .groupBy("root").agg(F.min_by("r", F.xxhash64("r.text")).alias(row)))
    return kept.unionAll(one.select(f"{row}.*"))
