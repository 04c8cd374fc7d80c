"""Token ids of whole texts with a public tokenizer, per Arrow batch.

The word tokenizer never joins characters across white space, so a text's ids
are its words' ids in order. A word of letters and closing marks is two pieces: its
letters and its marks. Each distinct piece of a slice is encoded once by the
tokenizers library (and kept in a bounded per-worker cache); pieces are told,
looked up and put together as Arrow and numpy arrays, not word by word.
"""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkpairs.llm.common import FlatWords, plain

TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 250_000  # pieces kept per Python worker; a full cache keeps those of the slice at hand
CHUNK = 256            # words encoded as one text
SLICE = 4 << 20        # bytes of text encoded at a time
GATHERED = 32_768      # words whose ids are copied at a time, in a core's cache
MARKS = "".join(c for c in string.punctuation if c != "'")  # a run of these after letters is a piece of its own
_PIECES = re.compile(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")  # of printable ASCII without apostrophes


@lru_cache(maxsize=2)
def encoder(name: str, cache_words: int = CACHE_WORDS) -> Encoder:
    return Encoder(name, cache_words)


class Encoder:
    """Ids by word, for one tokenizer file of the public tokenizers (their folder is
    found by the installed package, on every executor)."""

    def __init__(self, name: str = TOKENIZER, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # the cache: pieces, their ids one after the other, and the number of each one's
        self.names = pa.array([""], pa.large_string())
        self.ids, self.lens = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _single(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _whole(self, words: list[str]) -> list[list[int]]:
        """Ids of any words. The pieces of plain ASCII are known without encoding it; other words are encoded one by one."""
        simple = [w for w in words if w and w.isascii() and w.isprintable() and "'" not in w and "<|" not in w]
        found = dict(zip(simple, self._joined(simple, [len(_PIECES.findall(w)) for w in simple]), strict=True))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._single(rest), strict=True))
        return [found[w] for w in words]

    def _joined(self, words: list[str], pieces: list[int]) -> list[list[int]]:
        """Ids of words of so many pieces, many in one text; a piece's last id ends a word."""
        if (all_ := "".join(words)).isascii() and all_.isalpha():
            # each is one piece, which normalising and splitting leave as it is but for its case
            tokenize = self.model.tokenize
            return [[t.id for t in tokenize(w)] for w in map(str.lower, words)]
        texts = [" ".join(words[i:i + CHUNK]) for i in range(0, len(words), CHUNK)]
        out: list[list[int]] = []
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            part, last = words[k * CHUNK:(k + 1) * CHUNK], np.cumsum(pieces[k * CHUNK:(k + 1) * CHUNK])
            ids = e.ids
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != last[-1] or cuts[-1] != len(ids):
                out += self._single(part)
                continue
            at = 0
            for cut in cuts[last - 1].tolist():
                out.append(ids[at:cut])
                at = cut
        return out

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are not in the cache, one after the other, and their numbers."""
        letters = pc.utf8_is_alpha(pieces)
        ascii_ = pc.string_is_ascii(pieces)
        got: list[list[int]] = []
        order = []
        for kind, work in ((pc.and_(letters, ascii_), self._letters), (pc.and_not(letters, ascii_), self._letters), (pc.invert(letters), self._whole)):
            on = np.flatnonzero(np.asarray(kind))
            if len(on):
                got += work(strings(pieces.take(pa.array(on))))
                order.append(on)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), "<u4", int(lens.sum()))
        back = np.argsort(np.concatenate(order))
        return _runs(ids, (np.cumsum(lens) - lens)[back], lens[back]), lens[back]

    def _letters(self, words: list[str]) -> list[list[int]]:
        """Ids of words of letters only: each is one piece."""
        return self._joined(words, [1] * len(words))

    def _lookup(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and, for each of ``pieces`` (distinct), where its own start and how many they are; new ones join the cache."""
        at = pc.index_in(pieces, value_set=self.names)
        new = pieces.filter(at.is_null())
        names, ids, lens = self.names, self.ids, self.lens
        if len(new):
            more, more_lens = self._new(new)
            found = np.asarray(pc.fill_null(at, -1)).astype(np.int64)
            found[found < 0] = len(names) + np.arange(len(new))
            ids, lens = np.concatenate([ids, more]), np.concatenate([lens, more_lens])
            names = pa.concat_arrays([names, new])
        else:
            found = np.asarray(at)
        starts = (np.cumsum(lens) - lens)[found]
        if len(names) <= self.cache_words:
            self.names, self.ids, self.lens = names, ids, lens
        else:
            self.names, self.lens = pieces.slice(0, self.cache_words), lens[found][:self.cache_words]
            self.ids = _runs(ids, starts[:self.cache_words], self.lens)
        return ids, starts, lens[found]

    def parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of words (no nulls), one after the other, and their number by word."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        words = plain(words)
        stems = pc.ascii_rtrim(words, characters=MARKS)
        letters = np.array(pc.utf8_is_alpha(stems))
        # some letters become a letter and a mark when normalised, and that mark joins those that follow
        far = np.flatnonzero(letters & ~np.asarray(pc.string_is_ascii(stems)))
        some = stems.take(pa.array(far))
        letters[far] = np.asarray(pc.and_not(pc.utf8_is_alpha(pc.utf8_normalize(some, form="NFC")), pc.match_substring(some, "İ")))
        stems = pc.if_else(pa.array(letters), stems, "")
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
        cut = offsets[:-1] + np.asarray(pc.binary_length(stems))
        sizes = offsets[1:] - cut
        rest = _runs(np.frombuffer(words.buffers()[2] or b"", np.uint8), cut, sizes)
        ends = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(rest))
        both = pa.concat_arrays([stems, ends]).dictionary_encode()
        ids, starts, lens = self._lookup(both.dictionary)
        codes = np.asarray(both.indices).reshape(2, -1).T.ravel()  # a word's letters, then its marks
        return _runs(ids, starts[codes], lens[codes]), lens[codes].reshape(-1, 2).sum(1)

    def words(self, words: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each word."""
        ids, lens = self.parts(pa.array(words, pa.large_string()))
        data, ends = ids.tobytes(), (4 * np.cumsum(lens)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) of the texts and their offsets (null: empty)."""
        texts = plain(texts)
        return self.gather(FlatWords(texts if keeps_case(texts) else pc.ascii_lower(texts)))

    def gather(self, flat: FlatWords) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts already split into words."""
        ids, lens = self.parts(flat.dictionary)
        starts = np.cumsum(lens) - lens
        lens = lens[flat.codes]
        return _runs(ids, starts[flat.codes], lens), np.concatenate([[0], np.cumsum(lens)])[flat.offsets]


def _runs(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``values[starts[i]:starts[i] + lens[i]]`` one after the other."""
    ends = np.concatenate([[0], np.cumsum(lens)])
    out = np.empty(ends[-1], values.dtype)
    for i in range(0, len(starts), GATHERED):
        edges = ends[i:i + GATHERED + 1]
        at = np.repeat(starts[i:i + GATHERED] - (edges[:-1] - edges[0]), lens[i:i + GATHERED])
        at += np.arange(len(at))
        values.take(at, out=out[edges[0]:edges[-1]], mode="clip")  # all are in range; "raise" would copy
    return out


def strings(arr: pa.Array) -> list[str]:
    """The values of a string array without nulls."""
    return np.asarray(arr).tolist()


def keeps_case(texts: pa.Array) -> bool:
    """Whether a text may hold a special token's string, which is only one in its own case."""
    return bool(pc.any(pc.match_substring(texts, "<|")).as_py())
