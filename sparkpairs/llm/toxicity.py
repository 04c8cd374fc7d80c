"""Toxicity: a convolutional text classifier trained in numpy (operator 3).

A word's vector is its row of a hashed embedding table plus one channel with
the strongest evidence among its hashed character n-grams. Filters of several
widths slide over the whole text, each filter's maximum over the text is kept
(max pooling), and a logistic layer turns the maxima into a score. Training reads
every whole labelled text outside fold 0, dealt by hash: of ten parts five set the
embeddings' starting evidence (counts added up by Spark), four train the network and
one calibrates the thresholds of each language. The network starts from some hundred
steps on the first block of about ``BLOCK_CHARS`` characters; from there every block
learns from all its texts, and the blocks' weights are averaged, an embedding row by how
often each block met it. The score itself never sees language, source, label or id.

Edge cases: null and empty texts get the score of a text without words; labels
that are null or belong to no document are not used; several labels of one
document count as its largest; without labels of both classes every score is
the smoothed share of toxic labels (0 without labels); an empty table gives an
empty result; repeated rows are scored one by one; extra columns are carried
(``with_toxicity``) or ignored; null texts are scored, not learned from.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpairs.llm.common import FlatWords, crc_fold, free_name, plain, slices, with_struct
from sparkpairs.session import scratch_path

BITS = 18                 # hash buckets of words and of n-grams: 2 ** BITS each
DIM = 8                   # embedding channels; the last holds the n-gram evidence
WIDTHS = (1, 2, 3)        # filter widths in words
FILTERS = 8               # filters of each width
GRAMS = (4, 5)            # character n-grams, in bytes of the marked word
DEALT, EVIDENCE, HELD = 10, 5, 9   # parts of the labelled rows: the first ones are counted, the last one calibrates, the others train
BLOCK_CHARS = 8_000_000   # characters of a block of training texts
STEP_WORDS = 1 << 18      # words of a training step, and words pooled at a time
PASS_RATE = 0.1           # step size of the pass over all blocks, as a part of that at the start
ADDERS = 4                # tasks that add up the weights of the blocks
COUNT_BYTES = 1 << 20     # bytes of text counted at a time
SCORE_STEPS = 10_000      # thresholds are calibrated on scores to this part of 1
PAD = max(WIDTHS)         # padding words after each text, one window at least
_POSITION = np.random.default_rng(11).integers(1, 2**63, size=4096, dtype=np.uint64) | np.uint64(1)


# ---------------------------------------------------------------- features
def _bucket(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def word_features(words: pa.Array, chunk: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each distinct word, then n-gram buckets of all words and their offsets."""
    parts = [_features(words.slice(i, chunk)) for i in range(0, max(1, len(words)), chunk)]  # bounded memory
    word, grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return word, grams, np.concatenate([[0], np.cumsum(counts)])


def _features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    trimmed = pc.utf8_trim(pc.utf8_lower(plain(words)), characters=".,;:!?\"'()[]{}<>*_")
    marked = plain(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("<", trimmed, ">", ""))))
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[: len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[: offsets[-1]].astype(np.uint64) + np.uint64(1)
    lens = np.diff(offsets)
    found = []
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(offsets[:-1], lens)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * _POSITION[place % len(_POSITION)])])
        word = _bucket(sums[offsets[1:]] - sums[offsets[:-1]])
        left = np.repeat(offsets[1:], lens) - np.arange(len(data))  # bytes from here to the word's end
        owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + data[at + k] * _POSITION[k]
            found.append((owner[at], _bucket(h)))
    owner = np.concatenate([o for o, _ in found])
    grams = np.concatenate([g for _, g in found])
    order = np.argsort(owner, kind="stable")
    return word, grams[order], np.bincount(owner, minlength=len(lens))


def _segment_max(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Largest value of each segment, empty segments 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float32)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.maximum.reduceat(values, offsets[:-1][full], axis=0)
    return out


@dataclass(eq=False)
class Model:
    """``prior``: score without training (then the other fields are not used)."""

    prior: float = 0.0
    embedding: np.ndarray | None = None
    gram: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)  # one (width, DIM, FILTERS) for each width
    bias: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def word_vectors(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bucket, grams, offsets = word_features(words)
        x = self.embedding[bucket].copy()
        x[:, -1] = _segment_max(self.gram[grams], offsets)
        return bucket, x

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of whole texts; each filter's value is looked up per distinct word and summed over the width."""
        if self.embedding is None:
            return np.full(len(texts), self.prior)
        flat = FlatWords(texts)
        _, x = self.word_vectors(flat.dictionary)
        x = np.vstack([x, np.zeros((1, DIM), np.float32)])
        codes, offsets = padded(flat.codes, flat.offsets, len(x) - 1)
        pooled = []
        for w in self.filters:
            y = (x @ w[0])[codes]
            for k in range(1, len(w)):
                y[:-k] += (x @ w[k])[codes[k:]]
            close(y, offsets, len(w))
            pooled.append(_segment_max(y, offsets))
        h = np.maximum(np.hstack(pooled) + self.bias, 0)
        return 1 / (1 + np.exp(-(h @ self.weights + self.constant).astype(np.float64)))


def close(values: np.ndarray, offsets: np.ndarray, width: int) -> None:
    """Rules out the windows that would reach from one text into the next."""
    for k in range(1, width):
        values[offsets[1:] - k] = -np.inf


def padded(codes: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text followed by ``PAD`` padding words, as flat codes and offsets."""
    lens = np.diff(offsets)
    new = np.concatenate([[0], np.cumsum(lens + PAD)])
    out = np.full(new[-1], pad, np.int64)
    out[np.arange(len(codes)) + np.repeat(PAD * np.arange(len(lens)), lens)] = codes
    return out, new


# ---------------------------------------------------------------- training
def _text_counts(doc: np.ndarray, bucket: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Toxic and other texts that hold each bucket."""
    pairs = np.unique(doc.astype(np.int64) << BITS | bucket)
    b, y = pairs & ((1 << BITS) - 1), toxic[pairs >> BITS]
    return np.stack([np.bincount(b, y, minlength=1 << BITS), np.bincount(b, 1 - y, minlength=1 << BITS)])


def _log_odds(counts: np.ndarray, p: float, strength: float = 20.0) -> np.ndarray:
    """Log odds of a toxic text for each bucket, shrunk towards the share ``p`` of toxic texts."""
    p = min(max(p, 1e-3), 1 - 1e-3)
    odds = (counts[0] + strength * p) / (counts[1] + strength * (1 - p)) * (1 - p) / p
    return np.clip(np.log(odds), -4, 4).astype(np.float32)


def text_counts(flat: FlatWords, rows: np.ndarray, toxic: np.ndarray, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and other texts among ``rows`` that hold each bucket of words, and of n-grams."""
    bucket, grams, gram_offsets = features
    doc = flat.doc_of()
    on = np.isin(doc, rows)
    seen = np.unique(doc[on].astype(np.int64) * len(bucket) + flat.codes[on])
    d, c = seen // max(1, len(bucket)), seen % max(1, len(bucket))
    lens = np.diff(gram_offsets)[c]
    at = np.repeat(gram_offsets[:-1][c] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
    return _text_counts(d, bucket[c], toxic), _text_counts(np.repeat(d, lens), grams[at], toxic)


def begin(words: np.ndarray, parts: np.ndarray, share: float, mean: float, rng: np.random.Generator) -> Model:
    """A model before training, from counts of texts by bucket (``share``: of toxic ones among these)."""
    m = Model()
    m.embedding = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    m.embedding[:, 0] = _log_odds(words, share) / 2
    m.gram = _log_odds(parts, share) / 2
    m.embedding[:, -1] = 0
    m.filters = [rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    for w in m.filters:  # a filter of each width starts on each kind of evidence
        w[0, 0, 0] += 1
        w[0, -1, 1] += 1
    m.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    m.weights = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    m.constant = float(np.log(mean / (1 - mean)))
    return m


def _one_class(n: int, total: float, most: float) -> Model:
    return Model(prior=float((total + 0.5) / (n + 1)) if n and most > 0 else 0.0)


def fit(texts: pa.Array, toxic: np.ndarray, langs: list, seed: int = 5, steps: int = 400, batch: int = 64) -> Model:
    """Trains for at least ``steps`` batches (whole passes) on the given rows: the first half
    sets the embeddings' starting evidence, the other half trains the network, a fifth of
    which is held back for the thresholds."""
    toxic = np.asarray(toxic, np.float64)
    n = len(toxic)
    if not n or toxic.min() == toxic.max():
        return _one_class(n, toxic.sum(), toxic.max() if n else 0)
    rng = np.random.default_rng(seed)
    flat = FlatWords(texts)
    half = np.zeros(n, bool)
    half[rng.permutation(n)[: n // 2]] = True
    features = word_features(flat.dictionary)
    words, parts = np.zeros((2, 1 << BITS)), np.zeros((2, 1 << BITS))
    for rows in np.array_split(np.flatnonzero(half), max(1, n // 500)):  # a few texts at a time, to bound memory
        w, g = text_counts(flat, rows, toxic, features)
        words += w
        parts += g
    m = begin(words, parts, float(toxic[half].mean()), float(toxic.mean()), rng)
    rest = rng.permutation(np.flatnonzero(~half))
    train, held = rest[len(rest) // 5:], rest[: len(rest) // 5]
    learn(m, flat, features, toxic, train, rng, steps, batch)
    if len(held):
        s = m.score(texts.take(pa.array(held)))
        m.thresholds = calibrate(s, toxic[held], [langs[i] for i in held])
    return m


def _tops(m: Model, x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's maximum of every filter, and its first place, for texts whose words have the vectors ``x``."""
    pooled, tops = [], []
    for w in m.filters:
        y = x @ w[0]
        for k in range(1, len(w)):
            y[:-k] += x[k:] @ w[k]
        close(y, offsets, len(w))
        top = _segment_max(y, offsets)
        hit = y == np.repeat(top, np.diff(offsets), axis=0)
        pos = np.where(hit, np.arange(len(y))[:, None], len(y))
        tops.append(np.minimum.reduceat(pos, offsets[:-1], axis=0))
        pooled.append(top)
    return np.hstack(pooled), tops


def _pool(m: Model, vectors, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``_tops`` of padded texts; a text of more than ``STEP_WORDS`` words goes piece by piece."""
    if len(offsets) > 2 or len(codes) <= STEP_WORDS + PAD:
        return _tops(m, vectors(codes), offsets)
    best = None
    for s in range(0, len(codes) - PAD + 1, STEP_WORDS):
        piece = codes[s:s + STEP_WORDS + PAD - 1]
        pooled, tops = _tops(m, vectors(piece), np.array([0, len(piece)]))
        here = np.hstack(tops) + s
        best = (pooled, here) if best is None else (np.maximum(best[0], pooled), np.where(pooled > best[0], here, best[1]))
    return best[0], np.split(best[1], len(WIDTHS), axis=1)


def _batches(rows: np.ndarray, words: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """``batch`` rows at a time, fewer where they have more than ``STEP_WORDS`` words (one at least)."""
    for i in range(0, len(rows), batch):
        part = rows[i:i + batch]
        begin = 0
        while begin < len(part):
            n = max(1, int(np.searchsorted(np.cumsum(words[part[begin:]]), STEP_WORDS, "right")))
            yield part[begin:begin + n]
            begin += n


def learn(m: Model, flat: FlatWords, features: tuple[np.ndarray, np.ndarray, np.ndarray], toxic: np.ndarray, train: np.ndarray,
          rng: np.random.Generator, steps: int, batch: int = 64, rate: float = 1.0) -> None:
    """Trains ``m`` in place on the rows ``train``, in whole passes, until ``steps`` steps are made."""
    bucket, grams, gram_offsets = features
    bucket = np.append(bucket, -1)
    gram_value = np.append(_segment_max(m.gram[grams], gram_offsets), 0).astype(np.float32)
    params = [*m.filters, m.bias, m.weights]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    cm, cv, step = 0.0, 0.0, 0
    e2 = np.full((1 << BITS, 1), 1e-6, np.float32)

    def vectors(codes: np.ndarray) -> np.ndarray:
        b = bucket[codes]
        x = m.embedding[b]
        x[b < 0] = 0
        x[..., -1] = gram_value[codes]
        return x

    while step < steps and len(train):
        rng.shuffle(train)
        for rows in _batches(train, flat.counts(), batch):
            step += 1
            lens = flat.counts()[rows]
            ends = np.cumsum(lens)
            where = np.repeat(flat.offsets[:-1][rows] - (ends - lens), lens) + np.arange(lens.sum())
            codes, offsets = padded(flat.codes[where], np.concatenate([[0], ends]), len(bucket) - 1)
            pooled, tops = _pool(m, vectors, codes, offsets)
            z = pooled + m.bias
            h = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-(h @ m.weights + m.constant)))
            g = ((p - toxic[rows]) / len(rows)).astype(np.float32)
            gh = (g[:, None] * m.weights) * (z > 0)
            grads = []
            touched, change = [], []
            for j, w in enumerate(m.filters):
                gy = gh[:, j * FILTERS:(j + 1) * FILTERS]
                gw = np.zeros_like(w)
                for k in range(len(w)):
                    at = codes[np.minimum(tops[j] + k, len(codes) - 1)]
                    gw[k] = np.einsum("nfd,nf->df", vectors(at), gy)
                    touched.append(bucket[at].ravel())
                    change.append((gy[:, :, None] * w[k].T[None]).reshape(-1, DIM))
                grads.append(gw)
            grads += [gh.sum(0), h.T @ g]
            for q, gq, (a, v) in zip(params, grads, moments, strict=True):
                gq = gq + 1e-4 * q
                a += 0.1 * (gq - a)
                v += 0.001 * (gq * gq - v)
                q -= rate * 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            gc = float(g.sum())
            cm, cv = cm + 0.1 * (gc - cm), cv + 0.001 * (gc * gc - cv)
            m.constant -= rate * 0.01 * (cm / (1 - 0.9**step)) / (np.sqrt(cv / (1 - 0.999**step)) + 1e-8)
            t, ch = np.concatenate(touched), np.concatenate(change)
            ok = t >= 0
            u, inv = np.unique(t[ok], return_inverse=True)
            ge = np.zeros((len(u), DIM), np.float32)
            np.add.at(ge, inv, ch[ok])
            ge[:, -1] = 0
            e2[u] += (ge * ge).sum(1, keepdims=True)
            m.embedding[u] -= rate * 0.02 * ge / np.sqrt(e2[u])


def calibrate(scores: np.ndarray, toxic: np.ndarray, langs: list, least: int = 20, counts: np.ndarray | None = None) -> dict[str, float]:
    """For each language the threshold with the fewest errors, nearest to 0.5 among equals.

    Languages with fewer than ``least`` rows or one class only have none (0.5 holds). ``counts``: rows that each entry stands for."""
    counts = np.ones(len(scores)) if counts is None else np.asarray(counts, np.float64)
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        on = np.array([x == lang for x in langs])
        s, y, n = scores[on], toxic[on] > 0, counts[on]
        if n.sum() < least or y.all() or not y.any():
            continue
        edges, at = np.unique(s, return_inverse=True)
        cuts = np.append((edges[1:] + edges[:-1]) / 2, 0.5)
        below = [np.concatenate([[0], np.cumsum(np.bincount(at, n * of, minlength=len(edges)))]) for of in (y, ~y)]
        place = np.searchsorted(edges, cuts)
        errors = below[0][place] + below[1][-1] - below[1][place]
        best = cuts[errors == errors.min()]
        out[lang] = float(best[np.argmin(np.abs(best - 0.5))])
    return out


def evidence(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and other texts (``text, toxic``) that hold each bucket of words, and of n-grams. At most twice 2 ** BITS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, 1 << BITS))
        for b in batches:
            at = 0
            for part in slices(plain(b.column("text")), COUNT_BYTES):
                toxic = np.asarray(b.column("toxic").slice(at, len(part)))
                at += len(part)
                flat = FlatWords(part)
                total += np.stack(text_counts(flat, np.arange(len(part)), toxic, word_features(flat.dictionary)))
        total = total.transpose(0, 2, 1).reshape(-1, 2)  # by kind and bucket
        on = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on, 0]), pa.array(total[on, 1])], names=["at", "bad", "good"])

    got = (rows.select("text", "toxic").mapInArrow(count, "at bigint, bad double, good double")
           .groupBy("at").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow())
    out = np.zeros((2, 2 << BITS))
    for i, name in enumerate(("bad", "good")):
        out[i, np.asarray(got.column("at"))] = np.asarray(got.column(name))
    return out[:, :1 << BITS], out[:, 1 << BITS:]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Block, texts and labels of one block after the other, from rows sorted by block."""
    block, kept = None, []

    def done() -> tuple[int, pa.Array, np.ndarray]:
        t = pa.Table.from_batches(kept)
        return block, plain(t.column("text")), np.asarray(t.column("toxic"))

    for b in batches:
        blocks = np.asarray(b.column("block"))
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if kept and blocks[x] != block:
                yield done()
                kept = []
            block = int(blocks[x])
            kept.append(b.slice(x, y - x))
    if kept:
        yield done()


def _train_blocks(m: Model, rows: DataFrame, blocks: int, steps: int) -> Model:
    """``m`` after all rows (``h, text, toxic``): ``steps`` steps on the first block, then one pass over every block.
    Blocks and their order follow from the rows alone; the driver receives the model only."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.pmod("h", F.lit(blocks)).cast("bigint").alias("block"), "h", "text", "toxic")

    def work(start: Model, block: int, texts: pa.Array, toxic: np.ndarray, steps: int, rate: float) -> tuple[Model, np.ndarray]:
        mine = pickle.loads(pickle.dumps(start))
        flat = FlatWords(texts)
        features = word_features(flat.dictionary)
        learn(mine, flat, features, toxic, np.arange(len(toxic)), np.random.default_rng((5, block)), steps, rate=rate)
        return mine, np.bincount(features[0][flat.codes], minlength=1 << BITS)

    held = spark.sparkContext.broadcast(m)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts, toxic in _whole(batches):
            mine, _ = work(held.value, block, texts, toxic, steps, 1.0)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mine)], pa.binary())], names=["model"])

    made = (rows.where("block = 0").repartition(1).sortWithinPartitions("h", "text", "toxic")
            .mapInArrow(first, "model binary").toArrow())  # batches as they come: rows would be copied several times in the driver
    held.destroy()
    start = _model(made) if made.num_rows else m
    if blocks == 1:
        return start
    begun = spark.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = begun.value
        for block, texts, toxic in _whole(batches):
            mine, uses = work(start, block, texts, toxic, 1, PASS_RATE)
            met = np.flatnonzero(uses)
            change = (mine.embedding[met] - start.embedding[met]).astype(np.float64) * uses[met, None]
            other = np.concatenate([(a - b).ravel() for a, b in zip(_dense(mine), _dense(start), strict=True)]).astype(np.float64) * len(toxic)
            yield _sums(block, (len(toxic), met, uses[met], change, other))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, uses, change, other, at = 0, np.zeros(1 << BITS, np.int64), np.zeros((1 << BITS, DIM)), 0.0, None
        for b in batches:
            for block, x in zip(b.column("block").to_pylist(), b.column("sums"), strict=True):
                r, met, u, c, o = pickle.loads(x.as_py())
                rows, other, at = rows + r, other + o, block % ADDERS if at is None else at
                uses[met] += u
                change[met] += c
        if at is not None:
            met = np.flatnonzero(uses)
            yield _sums(at, (rows, met, uses[met], change[met], other))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in add(batches):
            rows, met, uses, change, other = pickle.loads(b.column("sums")[0].as_py())
            out = pickle.loads(pickle.dumps(begun.value))
            out.embedding[met] += (change / uses[:, None]).astype(np.float32)
            at = 0
            for p in _dense(out):
                p += (other[at:at + p.size] / rows).reshape(p.shape).astype(p.dtype)
                at += p.size
            out.constant += float(other[-1] / rows)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], names=["model"])

    schema = "block bigint, sums binary"
    learned = rows.repartition(n, "block").sortWithinPartitions("block", "h", "text", "toxic").mapInArrow(run, schema)
    # sums of the blocks of one remainder in their order, then of these few: the same however the blocks were learned
    sums = learned.repartitionById(ADDERS, F.pmod("block", F.lit(ADDERS)).cast("int")).sortWithinPartitions("block").mapInArrow(add, schema)
    made = sums.repartition(1).sortWithinPartitions("block").mapInArrow(mean, "model binary").toArrow()
    begun.destroy()
    return _model(made)


def _model(made: pa.Table) -> Model:
    """The model that a task made; its weights can be changed in place."""
    return pickle.loads(made.column("model")[0].as_buffer())


def _dense(m: Model) -> list[np.ndarray]:
    """The weights other than the embeddings; the constant last, as a copy."""
    return [*m.filters, m.bias, m.weights, np.array([m.constant])]


def _sums(block: int, sums: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pickle.dumps(sums)], pa.binary())], names=["block", "sums"])


_HELD: WeakKeyDictionary = WeakKeyDictionary()  # broadcasts of models in use


def _held(spark: SparkSession, m: Model) -> Broadcast:
    """The broadcast model, one for all that score with it; thresholds are not read from it."""
    if m not in _HELD or _HELD[m][0] is not spark.sparkContext:
        _HELD[m] = spark.sparkContext, spark.sparkContext.broadcast(m)
    return _HELD[m][1]


def _thresholds(m: Model, rows: DataFrame) -> dict[str, float]:
    """``calibrate`` on all rows (``text, toxic, lang``); counts by language, class and rounded score reach the driver."""
    held = _held(rows.sparkSession, m)
    scored = with_struct(rows, "text", "s", "score double", lambda t: pa.StructArray.from_arrays([pa.array(held.value.score(t))], names=["score"]))
    got = (scored.where("lang IS NOT NULL").groupBy("lang", (F.col("toxic") > 0).alias("bad"), F.round(F.col("s.score") * SCORE_STEPS).alias("step"))
           .agg(F.count(F.lit(1)).alias("n")).collect())
    return calibrate(np.array([r["step"] / SCORE_STEPS for r in got]), np.array([float(r["bad"]) for r in got]), [r["lang"] for r in got],
                     counts=np.array([r["n"] for r in got]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, steps: int = 400, block_chars: int = BLOCK_CHARS, seed: int = 5) -> Model:
    """Fits on every labelled row outside fold 0, whole texts. The rows are written once; counts
    of a fixed number of buckets and the model reach the driver."""
    spark = docs.sparkSession
    usable = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != 0))
              .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = (docs.where(F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), folds) != 0))
            .select("doc_id", "text", lang.cast("string").alias("lang")).join(usable.hint("merge"), "doc_id")  # the same plan at every size
            .withColumn("h", F.xxhash64("doc_id", "text")))
    path = scratch_path(spark, f"labelled-{uuid.uuid4().hex}")
    rows.select("h", F.pmod(F.xxhash64("h"), F.lit(DEALT)).cast("int").alias("part"), "toxic", "lang", "text") \
        .write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema("h bigint, part int, toxic double, lang string, text string").parquet(path)
    of = {r["part"]: r for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"), F.min("toxic").alias("least"),
                                                         F.max("toxic").alias("most"), F.sum(F.length("text")).alias("chars")).collect()}
    n, bad = sum(r["n"] for r in of.values()), sum(r["bad"] for r in of.values())
    most = max((r["most"] for r in of.values()), default=0)
    if not n or most == min(r["least"] for r in of.values()):
        return _one_class(n, bad, most)
    counted = [r for k, r in of.items() if k < EVIDENCE]
    share = sum(r["bad"] for r in counted) / max(1, sum(r["n"] for r in counted))
    m = begin(*evidence(kept.where(F.col("part") < EVIDENCE)), share, bad / n, np.random.default_rng(seed))
    chars = sum(r["chars"] for k, r in of.items() if EVIDENCE <= k < HELD)
    m = _train_blocks(m, kept.where((F.col("part") >= EVIDENCE) & (F.col("part") < HELD)), max(1, chars // block_chars), steps)
    m.thresholds = _thresholds(m, kept.where(F.col("part") == HELD))
    return m


# ---------------------------------------------------------------- scoring
def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``out``: score, predicted (score >= 0.5) and flagged
    (score at or above the threshold calibrated for the row's ``lang``, else 0.5)."""
    held = _held(docs.sparkSession, model)  # bounded by BITS and DIM

    def work(texts: pa.Array) -> pa.StructArray:
        s = held.value.score(texts)
        return pa.StructArray.from_arrays([pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["score", "predicted"])

    raw = free_name(docs, "_raw_toxicity")
    scored = with_struct(docs, text_col, raw, "score double, predicted int", work)
    cut = F.lit(0.5)
    if "lang" in docs.columns:
        for lang, t in model.thresholds.items():
            cut = F.when(F.col("lang") == lang, t).otherwise(cut)
    flagged = F.col(f"{raw}.score") >= cut
    return scored.withColumn(out, F.struct(F.col(f"{raw}.score").alias("score"), F.col(f"{raw}.predicted").alias("predicted"),
                                           flagged.alias("flagged"))).drop(raw)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the calibrated thresholds do not flag, with exactly its columns."""
    out = free_name(docs, "_toxicity")
    return with_toxicity(docs, model, out=out).where(~F.col(f"{out}.flagged")).drop(out)
