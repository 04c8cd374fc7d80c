"""Language-model scoring with causal self-attention in numpy (operator 9).

Counts (over all training documents, in Spark): how often each word occurs, from
those how often each subword id occurs and follows each class of ids inside a word,
and from the texts which ids stand beside the frequent ones. The classes of ids
come from these counts. A unigram base score of a text is the
sum over its words of log10((c + 1) / (N + V + 1)).

Model: one causal self-attention layer over subword ids predicts the class of
the next id; an id's share of its class comes from the corpus counts, so the
probabilities of all ids sum to one. Every text is tokenised once and its ids are written.
Training texts are dealt into blocks of about ``BLOCK_IDS`` ids by the hash of text and
doc_id. The network starts from one pass over the first block; from there every block
learns from every window of all its texts, and the blocks' weights are averaged in the order of the blocks, an
embedding row by how often each block met it. Blocks, their order and the order inside them
follow from the texts alone, so a score does not depend on the partitions of the
input. A text's ids are scored in windows of ``WINDOW`` ids that overlap by ``WINDOW - STRIDE``:
every id is scored once, with at least the overlap as context, all windows of a slice in
batched masked attention.

Words are counted by a partial count per batch and a shuffle by word. To score,
the ``HEAD_WORDS`` most frequent words are looked up in a broadcast table of that
size; each other word of a text travels once to the word's count and back.

Edge cases: a null or empty text has the end token only; a null doc_id counts as
the empty text in its fold; repeated rows are counted and scored one by one;
without training documents all counts are zero and every id is equally likely;
texts of any length are read, trained on and scored whole, in slices; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpairs.llm.common import FlatWords, plain, segment_sums, slices
from sparkpairs.llm.tokens import TOKENIZER, encoder, keeps_case
from sparkpairs.session import scratch_path

HEAD_WORDS = 131_072
WINDOW, STRIDE = 32, 24
DIM = 16
INPUTS = 4096          # embedding rows: the most frequent ids have their own
SINGLE, GROUPS, BANDS = 40, 20, 4   # classes: frequent ids alone, clusters of ids, frequency bands
BLOCK_IDS = 4_000_000  # ids of a block of training texts
RATE, LEAST = 0.03, 0.1   # step size at the start, and its part left at its end and after it
START_BATCH, PASS_BATCH = 256, 1024   # windows of a step at the start, and in the pass over all blocks
PART_WINDOWS = 64      # windows worked on at a time
SLICE = 2 << 20        # bytes of text worked on at a time
SCORE_IDS = 1 << 18    # ids scored at a time
WORKER_WORDS = 150_000  # words whose ids a worker keeps
ADDERS = 16            # tasks that add up the weights of the others; so many sums reach the driver
COMMON, BESIDE = 2000, 64   # ids that are clustered, by the ids beside them
PARTS = ("row bigint, word string, n bigint, doc_id bigint, n_tokens bigint, known bigint, base double, h bigint, train boolean, ids binary")


# ---------------------------------------------------------------- model
def id_ranks(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return rank


def beside(ranks: np.ndarray, same: np.ndarray | None = None) -> np.ndarray:
    """How often each common id stands before and after each of the most frequent (``same``:
    whether an id and the next are of one text)."""
    out = np.zeros(COMMON * 2 * BESIDE, np.int64)
    for side, (a, b) in enumerate(((ranks[1:], ranks[:-1]), (ranks[:-1], ranks[1:]))):
        on = (a < COMMON) & (b < BESIDE)
        if same is not None:
            on &= same
        out += np.bincount(a[on] * 2 * BESIDE + b[on] + BESIDE * side, minlength=len(out))
    return out.reshape(COMMON, 2 * BESIDE)


def id_classes(counts: np.ndarray, ids: np.ndarray | None = None, seed: int = 3, feature: np.ndarray | None = None) -> np.ndarray:
    """Class of every id: the most frequent alone, common ones clustered by the ids before
    and after them (``feature``, or counted in ``ids``), the rest by frequency."""
    rng = np.random.default_rng(seed)
    rank = id_ranks(counts)
    order = np.argsort(rank)
    classes = SINGLE + GROUPS + np.minimum(BANDS - 1, np.log2(1 + rank / COMMON).astype(np.int64))
    classes[order[:SINGLE]] = np.arange(SINGLE)
    middle = order[SINGLE:COMMON]
    if feature is None:
        feature = beside(rank[ids])
    x = feature[SINGLE:COMMON][: len(middle)].astype(np.float32)
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    if len(x) < GROUPS:
        return classes
    centre = x[rng.choice(len(x), GROUPS, replace=False)]
    for _ in range(15):
        near = np.argmax(2 * x @ centre.T - (centre**2).sum(1), axis=1)
        for g in range(GROUPS):
            if (near == g).any():
                centre[g] = x[near == g].mean(0)
    classes[middle] = SINGLE + near
    return classes


@dataclass
class Model:
    """``share``: log share of an id in its class, by the class of the id before it in
    its word (last row: at a word's start). ``starts``: ids after which a word starts."""

    inputs: np.ndarray      # embedding row of each id
    classes: np.ndarray     # class of each id
    starts: np.ndarray
    share: np.ndarray
    p: dict[str, np.ndarray]

    @property
    def end(self) -> int:
        return len(self.classes) - 1

    def layout(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and targets (-1: padding) in one row of ``STRIDE``-long parts after ``BACK``
        leading ones, the first part of each text, and the text of each part.

        Text i reads end, id 0, id 1, ... and predicts id 0, id 1, ..., end. A window is a
        part and the ``BACK`` inputs before it."""
        lens = np.diff(off) + 1
        parts = -(-lens // STRIDE)
        first = np.cumsum(parts) - parts
        size = BACK + STRIDE * int(parts.sum())
        target = np.full(size, -1, np.int32)
        source = np.full(size, self.end, np.int32)
        begin = BACK + STRIDE * first
        at = np.arange(len(ids)) + np.repeat(begin - off[:-1], lens - 1)
        target[at] = ids
        target[begin + lens - 1] = self.end
        source[at + 1] = ids  # never past the text's last part: its end is predicted there
        return source, target, first, np.repeat(np.arange(len(lens)), parts)

    def attend(self, q: np.ndarray, k: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention of the last STRIDE places of each window, and its sums; ``fresh``: windows that begin a text."""
        s = q @ np.ascontiguousarray(k.transpose(0, 2, 1))  # a transposed view is multiplied more slowly
        s += np.where(_CAUSAL, self.p["place"], np.float32(-1e9))
        s[fresh, :, :BACK] = -1e9
        if s.max() > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        return s, (s @ _ONES[:WINDOW])[:, :, None]

    def score(self, ids: np.ndarray, off: np.ndarray, batch: int = PART_WINDOWS) -> np.ndarray:
        """log10 probability of each text, its end included."""
        source, target, first, text = self.layout(ids, off)
        is_first = np.zeros(len(text), bool)
        is_first[first] = True
        total = np.zeros(len(text))
        classes = self.classes[target]
        before = np.where(self.starts[source], len(self.share) - 1, self.classes[source])
        within = self.share[before, target]
        rows = np.lib.stride_tricks.sliding_window_view(self.inputs[source], WINDOW)[::STRIDE]
        embed = self.p["embed"]
        q, k, v = (embed @ self.p[name] for name in "qkv")  # of every row once, then looked up
        out = np.vstack([self.p["out"], self.p["bias"]])
        for i in range(0, len(text), batch):
            n = min(batch, len(text) - i)
            here = slice(i * STRIDE + BACK, (i + n) * STRIDE + BACK)
            at = rows[i:i + n]
            mine = np.ascontiguousarray(at[:, BACK:])
            s, sums = self.attend(q.take(mine, axis=0), k.take(at, axis=0), np.flatnonzero(is_first[i:i + n]))
            h = np.empty((n * STRIDE, DIM + 1), np.float32)  # and a one, for the bias
            seen = s @ v.take(at, axis=0)
            seen /= sums
            np.add(seen.reshape(-1, DIM), embed.take(mine.ravel(), axis=0), out=h[:, :DIM])
            h[:, DIM] = 1
            logits = h @ out
            got = logits[np.arange(len(logits)), classes[here]]
            with np.errstate(over="ignore"):
                sums = np.exp(logits, out=logits) @ _ONES[:N_CLASSES]
            if not np.isfinite(sums).all():  # a logit past the range of exp
                logits = h @ out
                most = logits.max(-1, keepdims=True)
                sums, got = np.exp(logits - most).sum(-1), got - most[:, 0]
            lp = got - np.log(sums) + within[here]
            total[i:i + n] = np.where(target[here] >= 0, lp, 0).reshape(n, STRIDE).sum(1, dtype=np.float64)
        return np.bincount(text, total, minlength=len(off) - 1) / math.log(10)


BACK = WINDOW - STRIDE
#: Scored place i of a window sees the window up to itself.
_CAUSAL = np.arange(WINDOW)[None, :] <= np.arange(BACK, WINDOW)[:, None]
N_CLASSES = SINGLE + GROUPS + BANDS
_ONES = np.ones(max(WINDOW, N_CLASSES), np.float32)  # rows are added up by a product with it


def shares(pairs: np.ndarray, classes: np.ndarray, strength: float = 30.0) -> np.ndarray:
    """Log share of each id in its class by what stands before it (``pairs``: rows by class,
    the last for word starts), shrunk towards the share whatever stands before it."""
    counts = pairs.sum(0) + 1.0
    overall = counts / np.bincount(classes, counts, minlength=N_CLASSES)[classes]
    out = np.empty(pairs.shape, np.float32)
    for i, row in enumerate(pairs):
        total = np.bincount(classes, row, minlength=N_CLASSES)[classes]
        out[i] = np.log((row + strength * overall) / (total + strength))
    return out


def fresh(classes: np.ndarray, starts: np.ndarray, pairs: np.ndarray, seed: int = 4) -> Model:
    """A model before training; ``pairs``: counts of ids by what stands before them."""
    rng = np.random.default_rng(seed)
    counts = pairs.sum(0)
    order = np.argsort(-counts, kind="stable")
    inputs = np.empty(len(counts), np.int32)
    inputs[order] = np.minimum(np.arange(len(counts)), INPUTS - 1)
    total = np.bincount(classes, counts + 1, minlength=N_CLASSES)
    prior = np.log((total + 1e-9) / total.sum())  # a class without ids is never predicted
    p = {"embed": rng.normal(0, 0.3, (INPUTS, DIM)), "place": np.zeros((STRIDE, WINDOW)), "q": rng.normal(0, 0.2, (DIM, DIM)),
         "k": rng.normal(0, 0.2, (DIM, DIM)), "v": rng.normal(0, 0.2, (DIM, DIM)), "out": rng.normal(0, 0.05, (DIM, N_CLASSES)), "bias": prior}
    return Model(inputs, classes, starts, shares(pairs, classes), {k: v.astype(np.float32) for k, v in p.items()})


def learn(start: Model, ids: np.ndarray, off: np.ndarray, first: bool = False) -> tuple[Model, int]:
    """``start`` after every window of the texts of a block (``first``: in small and shrinking steps), and the
    number of windows."""
    m = Model(start.inputs, start.classes, start.starts, start.share, {k: v.copy() for k, v in start.p.items()})
    trainer, rng = Trainer(m), np.random.default_rng(5)
    data = trainer.windows(ids, off)
    batch = START_BATCH if first else PASS_BATCH
    order = rng.permutation(len(data[2]))
    steps = -(-len(order) // batch)
    for i in range(steps):
        rate = RATE * min(1, (i + 1) / 30) * (1 - (1 - LEAST) * (i + 1) / steps) if first else RATE * LEAST
        trainer.step(data, order[i * batch:(i + 1) * batch], rate)
    return m, len(order)


class Trainer:
    """Adam steps on the weights of a model, in place."""

    def __init__(self, m: Model):
        self.m, self.steps = m, 0
        self.first = {k: np.zeros_like(v) for k, v in m.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in m.p.items()}
        self.buffers = np.empty((2, 0, WINDOW, DIM), np.float32)  # gradients of a step's inputs, and sorted by id

    def windows(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows and target classes (-1: padding) of each window, and whether it begins a text: those of ``layout``,
        written text by text, as a block's places would take many times its ids."""
        m, lens = self.m, np.diff(off) + 1
        parts = -(-lens // STRIDE)
        first = np.cumsum(parts) - parts
        n = int(parts.sum())
        fresh = np.zeros(n, bool)
        fresh[first] = True
        rows = np.full(BACK + STRIDE * n, m.inputs[m.end], np.uint16)  # INPUTS at most; 16 bits are sorted fast
        goal = np.full(STRIDE * n, -1, np.int16)
        for a, b, at in zip(off[:-1].tolist(), off[1:].tolist(), (STRIDE * first).tolist(), strict=True):
            rows[BACK + at + 1:BACK + at + 1 + b - a] = m.inputs[ids[a:b]]
            goal[at:at + b - a] = m.classes[ids[a:b]]
            goal[at + b - a] = m.classes[m.end]
        return np.lib.stride_tricks.sliding_window_view(rows, WINDOW)[::STRIDE], goal.reshape(-1, STRIDE), fresh

    def step(self, data: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, rate: float) -> None:
        """One step on the windows ``at``; their gradients are added up ``PART_WINDOWS`` at a time, which fit a core's cache."""
        p, (rows, goals, fresh) = self.m.p, data
        self.steps += 1
        x_ids, goal = rows[at], goals[at]
        scale = np.float32(1 / max(1, (goal >= 0).sum()))
        if self.buffers.shape[1] < len(at):
            self.buffers = np.empty((2, len(at), WINDOW, DIM), np.float32)
        dx, moved = self.buffers[:, :len(at)]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for i in range(0, len(at), PART_WINDOWS):
            here = slice(i, i + PART_WINDOWS)
            self._gradients(g, dx[here], x_ids[here], goal[here].ravel(), np.flatnonzero(fresh[at[here]]), scale)
        order = np.argsort(x_ids.ravel(), kind="stable")
        sorted_ids = x_ids.ravel()[order]
        begins = np.flatnonzero(np.diff(sorted_ids, prepend=sorted_ids[0] + np.uint16(1)))
        dx.reshape(-1, DIM).take(order, axis=0, out=moved.reshape(-1, DIM), mode="clip")  # all are in range; "raise" would copy
        g["embed"][sorted_ids[begins]] = np.add.reduceat(moved.reshape(-1, DIM), begins, axis=0)
        much, little = np.float32(rate / (1 - 0.9**self.steps)), np.float32(1 / np.sqrt(1 - 0.99**self.steps))
        for name, w in p.items():
            first, second = self.first[name], self.second[name]
            first += np.float32(0.1) * (g[name] - first)
            second += np.float32(0.01) * (g[name] ** 2 - second)
            w -= much * first / (np.sqrt(second) * little + np.float32(1e-8))

    def _gradients(self, g: dict[str, np.ndarray], dx: np.ndarray, x_ids: np.ndarray, goal: np.ndarray, fresh: np.ndarray, scale: np.float32) -> None:
        """Adds the gradients of some windows to ``g`` and writes those of their inputs to ``dx``."""
        m, p = self.m, self.m.p
        flat = p["embed"].take(x_ids.ravel(), axis=0)
        x = flat.reshape(*x_ids.shape, DIM)
        k, v = (flat @ p["k"]).reshape(x.shape), (flat @ p["v"]).reshape(x.shape)
        q = x[:, BACK:] @ p["q"]
        a, sums = m.attend(q, k, fresh)
        seen = a @ v
        seen /= sums
        h = np.empty((len(goal), DIM + 1), np.float32)  # and a one, for the bias
        h[:, :DIM] = (seen + x[:, BACK:]).reshape(-1, DIM)
        h[:, DIM] = 1
        e = h @ np.vstack([p["out"], p["bias"]])
        if e.max() > 60:  # near the range of exp
            e -= e.max(-1, keepdims=True)
        np.exp(e, out=e)
        # rows of e, of h and of the gradients stay unscaled where a column of weights can be put on the narrower side
        total = e @ _ONES[:N_CLASSES]
        ok = goal >= 0
        weight = (ok * scale / total)[:, None]
        on = np.flatnonzero(ok)
        e[on, goal[on]] -= total[on]
        h *= weight
        out = h.T @ e
        g["out"] += out[:DIM]
        g["bias"] += out[DIM]
        dh = e @ np.ascontiguousarray(p["out"].T)
        dh *= weight
        dh = dh.reshape(q.shape)
        ahead = dh / sums
        ds = ahead @ np.ascontiguousarray(v.transpose(0, 2, 1))
        dv = (a.transpose(0, 2, 1) @ ahead).reshape(-1, DIM)
        ds -= np.einsum("nij,nij->ni", ahead, seen)[:, :, None]
        ds *= a
        dq, dk = (ds @ k).reshape(-1, DIM), (ds.transpose(0, 2, 1) @ q).reshape(-1, DIM)
        g["place"] += ds.sum(0)
        g["q"] += x[:, BACK:].reshape(-1, DIM).T @ dq
        g["k"] += flat.T @ dk
        g["v"] += flat.T @ dv
        dk = dk @ p["k"].T
        dk += dv @ p["v"].T
        dx[:] = dk.reshape(x.shape)
        dh += (dq @ p["q"].T).reshape(dh.shape)
        dx[:, BACK:] += dh


def id_type(size: int) -> np.dtype:
    """Little-endian type that ids below ``size`` are written in."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def binary_ids(ids: np.ndarray, off: np.ndarray, size: int) -> pa.Array:
    """``ids[off[i]:off[i+1]]`` as binary values: Spark copies them whole, not id by id."""
    of = id_type(size)
    bounds, data = (pa.py_buffer(np.ascontiguousarray(x)) for x in (off.astype(np.int32) * np.int32(of.itemsize), ids.astype(of)))
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, bounds, data])


def flat_ids(arr: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets (from 0) of an array of ``binary_ids``."""
    of = id_type(size)
    wide = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    off = np.frombuffer(arr.buffers()[1], wide)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(of) if data is not None else np.zeros(0, of)
    return ids, (off - off[0]) // of.itemsize


def _by_block(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Block, ids and offsets of one block after the other, from rows sorted by block."""

    def whole() -> tuple[int, np.ndarray, np.ndarray]:
        out = block, np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(lens))])
        ids.clear()  # they hold whole batches
        lens.clear()
        return out

    block, ids, lens = None, [], []
    for b in batches:
        blocks = np.asarray(b.column("block"))
        values, off = flat_ids(b.column("ids"), size)
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if block is not None and blocks[x] != block:
                yield whole()
            block = int(blocks[x])
            ids.append(values[off[x]:off[y]])
            lens.append(np.diff(off[x:y + 1]))
    if block is not None:
        yield whole()


def _pack(m: Model, windows: int, uses: np.ndarray, places: int) -> bytes:
    """Weights times what they count for; sums of these add up."""
    return np.concatenate([[places, windows], uses, (m.p["embed"] * uses[:, None].astype(np.float64)).ravel(),
                           *(m.p[k].astype(np.float64).ravel() * windows for k in m.p if k != "embed")]).tobytes()


def _unpack(total: np.ndarray, m: Model) -> tuple[Model, int]:
    """``m`` with the mean weights of a sum, and the places that gave it."""
    places, windows = total[:2]
    uses, at = total[2:2 + INPUTS], 2 + INPUTS
    mean = total[at:at + INPUTS * DIM].reshape(INPUTS, DIM) / np.maximum(uses, 1)[:, None]
    p = {"embed": np.where(uses[:, None] > 0, mean, m.p["embed"]).astype(np.float32)}
    at += INPUTS * DIM
    for k in m.p:
        if k != "embed":
            n = m.p[k].size
            p[k] = (total[at:at + n] / windows).reshape(m.p[k].shape).astype(np.float32)
            at += n
    return Model(m.inputs, m.classes, m.starts, m.share, p), int(places)


def train_blocks(m: Model, texts: DataFrame, blocks: int, first: bool = False) -> tuple[Model, int]:
    """``m`` after the texts (``h, ids``) of all blocks (``first``: of the first one), and the ids they gave it (ends included)."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(Model(m.inputs, m.classes, m.starts, m.share[:0], m.p))  # learning needs no shares
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.pmod("h", F.lit(blocks)).cast("bigint").alias("block"), "h", "ids")
    rows = rows.where("block = 0").repartition(1) if first else rows.repartition(n, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = held.value
        for block, ids, off in _by_block(batches, start.end):
            mine, windows = learn(start, ids, off, first)
            uses = sum((np.bincount(mine.inputs[ids[i:i + SCORE_IDS]], minlength=INPUTS) for i in range(0, len(ids), SCORE_IDS)),
                       np.zeros(INPUTS, np.int64))
            uses[mine.inputs[mine.end]] += len(off) - 1
            total = _pack(mine, max(1, windows), uses, len(ids) + len(off) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total], pa.binary())], names=["block", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = None, 0
        for b in batches:
            for block, x in zip(b.column("block").to_pylist(), b.column("total"), strict=True):
                x = np.frombuffer(x.as_py())
                total, at = (x, block % ADDERS) if total is None else (total + x, at)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], names=["block", "total"])

    learned = rows.sortWithinPartitions("block", "h").mapInArrow(run, "block bigint, total binary")
    # an adder takes the blocks of one remainder, in their order: the sum is the same however they were learned
    sums = (learned.repartitionById(ADDERS, F.pmod("block", F.lit(ADDERS)).cast("int")).sortWithinPartitions("block")
            .mapInArrow(add, "block bigint, total binary").collect())
    held.unpersist()
    if not sums:
        return m, 0
    return _unpack(sum(np.frombuffer(r["total"]) for r in sorted(sums, key=lambda r: r["block"])), m)


# ---------------------------------------------------------------- counts
def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, c``: occurrences of each word (A-Z in lower case) of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(pc.ascii_lower(plain(b.column(0))), 4 * SLICE):
                flat = FlatWords(part)
                n = np.bincount(flat.codes, minlength=len(flat.dictionary))
                on = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(on)).cast(pa.string()), pa.array(n[on])], names=["word", "n"])

    return docs.select(text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def head_count(words: DataFrame, most: int = HEAD_WORDS) -> int:
    """Least count such that at most ``most`` words have it or more, from counts per
    eighth of an octave (a few hundred rows)."""
    step = F.floor(F.log2("c") * 8).cast("int")
    rows = words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    total, out = 0, 2**62
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        out = r["least"]
    return out


def word_ids(words: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``words`` (``word, c``) and the ids of each word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, WORKER_WORDS)
        for b in batches:
            ids, lens = enc.parts(b.column("word"))
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), binary_ids(ids, np.concatenate([[0], np.cumsum(lens)]), enc.size)],
                                             names=["word", "c", "ids"])

    return words.select("word", "c").mapInArrow(work, "word string, c bigint, ids binary")


def id_pairs(words: DataFrame, classes: np.ndarray, texts: int, tokenizer: str = TOKENIZER) -> np.ndarray:
    """Occurrences of each subword id by the class of the id before it in its word (last
    row: at a word's start), from the counted words (encoded here if they come without ``ids``); the end once for
    each of ``texts``. At most classes x vocabulary numbers reach the driver."""
    if "ids" not in words.columns:
        words = word_ids(words, tokenizer)
    ends = encoder(tokenizer).ends

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_CLASSES + 1) * len(classes), np.int64)
        for b in batches:
            ids, off = flat_ids(b.column("ids"), len(ends))
            ids, lens = ids.astype(np.int64), np.diff(off)
            before = np.concatenate([[N_CLASSES], classes[ids[:-1]]])[: len(ids)]
            before[1:][ends[ids[:-1]]] = N_CLASSES  # a word of several pieces, and the next word
            before[(np.cumsum(lens) - lens)[lens > 0]] = N_CLASSES
            np.add.at(total, before * len(classes) + ids, np.repeat(np.asarray(b.column("c")), lens))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["pair", "n"])

    rows = words.select("ids", "c").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((N_CLASSES + 1) * len(classes), np.int64)
    out[np.asarray(rows.column("pair"))] = np.asarray(rows.column("n"))
    out[-1] += texts
    return out.reshape(N_CLASSES + 1, len(classes))


def corpus_beside(texts: DataFrame, ranks: np.ndarray) -> np.ndarray:
    """``beside`` of all training texts (``ids``). At most COMMON x 2 x BESIDE numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COMMON * 2 * BESIDE, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids, off = flat_ids(b.column(0).slice(at, 500), len(ranks) - 1)
                text = np.repeat(np.arange(len(off) - 1), np.diff(off))
                total += beside(ranks[ids], text[1:] == text[:-1]).ravel()
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["pair", "n"])

    rows = texts.select("ids").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COMMON * 2 * BESIDE, np.int64)
    out[np.asarray(rows.column("pair"))] = np.asarray(rows.column("n"))
    return out.reshape(COMMON, 2 * BESIDE)


def corpus_classes(words: DataFrame, texts: DataFrame, n_texts: int, tokenizer: str = TOKENIZER) -> np.ndarray:
    """Class of every id from the counts of all training texts."""
    size = encoder(tokenizer).size + 1
    counts = id_pairs(words, np.zeros(size, np.int64), n_texts, tokenizer).sum(0)
    return id_classes(counts, feature=corpus_beside(texts, id_ranks(counts)))


# ---------------------------------------------------------------- operator
def encoded_parts(docs: DataFrame, training, head: dict[str, int], n_train: int, text_col: str, tokenizer: str) -> DataFrame:
    """``PARTS`` rows of all documents, from one pass over their texts: a row per text with its ids, its number of
    tokens and the part of its base score that the words of ``head`` give; and one for each of its other words."""
    names, counts = pa.array(list(head), pa.large_string()), np.array([*head.values(), 0], np.int64)  # and a zero for all others
    held = docs.sparkSession.sparkContext.broadcast((names, counts))  # HEAD_WORDS at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = held.value
        enc = encoder(tokenizer, WORKER_WORDS)
        for b in batches:
            at = 0
            for part in slices(plain(b.column("t")), SLICE):
                n = len(part)
                flat = FlatWords(pc.ascii_lower(part))
                ids, off = enc.encode(part) if keeps_case(part) else enc.gather(flat)
                c = counts[np.asarray(pc.fill_null(pc.index_in(flat.dictionary, value_set=names), len(names)))]
                per_word = c[flat.codes]
                known = segment_sums((per_word > 0).astype(np.int64), flat.offsets) + (n_train > 0)
                base = segment_sums(np.log10(c + 1.0)[flat.codes], flat.offsets) + math.log10(n_train + 1)
                rows = np.asarray(b.column("row").slice(at, n))
                # words outside the head: one row for each text and word
                rare = per_word == 0
                pairs, times = np.unique(flat.doc_of()[rare] * (len(c) + 1) + flat.codes[rare], return_counts=True)
                doc, code = pairs // (len(c) + 1), pairs % (len(c) + 1)
                yield _parts(word=pa.array([f" {r}" for r in rows.tolist()], pa.string()),  # a key that is no word (words hold no space)
                             row=rows, doc_id=b.column("id").slice(at, n), n_tokens=flat.counts() + 1, known=known, base=base,
                             h=b.column("h").slice(at, n), train=b.column("train").slice(at, n),
                             ids=binary_ids(ids, off, enc.size))
                yield _parts(row=rows[doc], word=flat.dictionary.take(pa.array(code)).cast(pa.string()), n=times)
                at += n

    h = F.xxhash64(text_col, "doc_id")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("id"), h.alias("h"),
                       F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).alias("t"))
    return rows.mapInArrow(work, PARTS)


_PART_TYPES = {"row": pa.int64(), "word": pa.string(), "n": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(),
               "base": pa.float64(), "h": pa.int64(), "train": pa.bool_(), "ids": pa.binary()}


def _parts(**columns) -> pa.RecordBatch:
    n = len(columns["row"])
    cols = [pa.nulls(n, t) if (c := columns.get(k)) is None else c if isinstance(c, pa.Array) else pa.array(c, t) for k, t in _PART_TYPES.items()]
    return pa.RecordBatch.from_arrays(cols, names=list(_PART_TYPES))


def model_scores(texts: DataFrame, model: Model) -> DataFrame:
    """``row, score`` of every text (``row, ids``)."""
    held = texts.sparkSession.sparkContext.broadcast(model)  # bounded by INPUTS and the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            ids, off = flat_ids(b.column("ids"), model.end)
            rows, at, out = b.column("row"), 0, []
            while at < len(off) - 1:
                end = max(at + 1, int(np.searchsorted(off, off[at] + SCORE_IDS, "right")) - 1)
                out.append(model.score(ids[off[at]:off[end]], off[at:end + 1] - off[at]))
                at = end
            yield pa.RecordBatch.from_arrays([rows, pa.array(np.concatenate([np.zeros(0), *out]))], names=["row", "score"])

    return texts.select("row", "ids").mapInArrow(run, "row bigint, score double")


def score(docs: DataFrame, training, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row;
    ``training``: boolean column that marks the rows to learn from."""
    spark = docs.sparkSession
    train = docs.where(training)
    path, kept = (scratch_path(spark, f"{x}-{uuid.uuid4().hex}") for x in ("words", "ids"))
    word_ids(word_counts(train, text_col), tokenizer).write.parquet(path)
    words = spark.read.schema("word string, c bigint, ids binary").parquet(path)
    n_train = train.count()
    got = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = got["n"] + n_train, got["v"] + (n_train > 0)
    head = {r["word"]: r["c"] for r in words.where(F.col("c") >= head_count(words)).collect()}  # HEAD_WORDS at most

    encoded_parts(docs, training, head, n_train, text_col, tokenizer).write.option("compression", "zstd").parquet(kept)
    parts = spark.read.schema(PARTS).parquet(kept)
    texts = parts.where("n_tokens IS NOT NULL")
    known = texts.where("train")
    classes = corpus_classes(words, known, n_train, tokenizer)
    starts = np.append(encoder(tokenizer).ends, True)  # after a word's last id, and at a text's start
    pairs = id_pairs(words, classes, n_train, tokenizer)
    blocks = max(1, int(pairs.sum()) // BLOCK_IDS)
    model, _ = train_blocks(fresh(classes, starts, pairs), known, blocks, first=True)
    model, _ = train_blocks(model, known, blocks)

    keyed = model_scores(texts, model).select("row", F.concat(F.lit(" "), F.col("row").cast("string")).alias("word"), "score")
    rows = parts.select("row", "word", "n", "doc_id", "n_tokens", "known", "base").unionByName(keyed, allowMissingColumns=True)
    joined = rows.join(words.select("word", "c"), "word", "left")
    hit = F.col("n").isNotNull() & F.col("c").isNotNull()
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"),
        F.sum(F.when(hit, F.col("n")).otherwise(F.coalesce("known", F.lit(0)))).alias("n_known"),
        F.sum(F.when(hit, F.col("n") * F.log10(F.col("c") + 1.0)).otherwise(F.coalesce("base", F.lit(0.0)))).alias("logs"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
                      (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(tokens + kinds + 1))).alias("base_score"), "score")
