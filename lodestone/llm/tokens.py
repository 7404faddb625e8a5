"""Token ids by a public tokenizer, word by word.

A tokenizer that drops white space never joins across it, and its normaliser
works within runs that white space ends, so a text's ids are its words' ids one
after another; and where it parts closing marks from a letter or digit before
them, a word's ids are those of both. (Others encode whole texts.) Each worker
keeps the ids of the parts it has met (at most MOST, then it starts anew),
which the tokenizers library encoded once, under their 64-bit hashes; a text
costs one look-up per different word of its batch.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.kernels import buffers, span_hashes

MOST = 2_000_000
DEFAULT = "word_bpe_49k.json"
CLOSING = b".,;:!?\"')]}-#*$%&"
_CLOSES, _SOLID = np.zeros(256, bool), np.zeros(256, bool)
_CLOSES[list(CLOSING)] = True
_SOLID[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class Table:
    """Numbers of 64-bit hashes, in the order in which they came (open addressing)."""

    def __init__(self, bits: int = 16):
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is new."""
        mask = np.uint64(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        have = self.keys[at]
        out = np.where(have == h, self.numbers[at], -1)
        left = np.flatnonzero((have != h) & (have != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(mask)
            have = self.keys[at[left]]
            hit = have == h[left]
            out[left[hit]] = self.numbers[at[left[hit]]]
            left = left[~hit & (have != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers new, different hashes."""
        while 2 * (self.n + len(h)) > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, numbers = self.keys[old], self.numbers[old]
            self.keys, self.numbers = np.zeros(2 * len(self.keys), np.uint64), np.zeros(2 * len(self.keys), np.int32)
            self._put(keys, numbers)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = h[free]  # of those that meet in one place, the last stays
            mine = self.keys[at[left]] == h[left]
            self.numbers[at[left[mine]]] = numbers[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & mask


class Encoder:
    def __init__(self, path: str, most: int = MOST):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = ids(" a \n b.\t") == ids("a") + ids("b.")
        self.lower = self.by_word and "Lowercase" in str(self.tokenizer.normalizer)
        # Words are normalised before they are joined, most of them by lower case alone.
        self.normal = self.tokenizer.normalizer and self.tokenizer.normalizer.normalize_str
        seen = "".join(map(chr, range(33, 127)))
        self.ascii = not self.normal or self.normal(seen) == (seen.lower() if self.lower else seen)
        self.plain = Tokenizer.from_file(path)
        if self.normal:
            self.plain.normalizer = normalizers.Sequence([])
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.closing = self.by_word and self._parts_closing(ids)
        self._clear()

    def _parts_closing(self, ids) -> bool:
        """Whether closing marks never share an id with a letter or digit before them."""
        marks = CLOSING.decode()
        if any(m in x for x in self.added for m in marks):  # a special token may end in one
            return False
        ends = [chr(c) for c in np.flatnonzero(_SOLID)]
        words = [f"x{e}{m}" for e in ends for m in (*marks, marks[::-1])]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return got == [ids(f"x{e}") + ids(m) for e in ends for m in (*marks, marks[::-1])]

    def _clear(self) -> None:
        self.index = Table()
        self.flat = np.empty(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.n = 0

    def _normalised(self, word: str) -> str:
        if self.ascii and word.isascii():
            return word.lower() if self.lower else word
        return self.normal(word) if self.normal else word

    def _encoded(self, words: list[bytes]) -> tuple[list[int], np.ndarray]:
        """The ids of new words one after another, and how many each has."""
        ids: list[int] = []
        lengths = np.zeros(len(words), np.int64)
        chunks, at = [], []
        for i in range(0, len(words), 256):
            some = [w.decode() for w in words[i : i + 256]]
            joined = " ".join(some).lower()
            if any(x in joined for x in self.added):  # special tokens are told before anything else
                for j, w in enumerate(some):
                    ids_ = self.tokenizer.encode(w, add_special_tokens=False).ids
                    chunks.append(None)
                    at.append((i + j, ids_))
                continue
            some = list(map(self._normalised, some))
            chunks.append(" ".join(some))
            at.append((i, np.cumsum([0, *(len(w) + 1 for w in some)])))
        encoded = iter(self.plain.encode_batch([c for c in chunks if c is not None], add_special_tokens=False))
        for chunk, (i, place) in zip(chunks, at, strict=True):
            if chunk is None:
                ids += place
                lengths[i] = len(place)
                continue
            e = next(encoded)
            ids += e.ids
            of = np.searchsorted(place, np.array([s for s, _ in e.offsets], np.int64), "right") - 1
            n = len(place) - 1
            lengths[i : i + n] = np.bincount(of, minlength=n)[:n]
        return ids, lengths

    def _append(self, ids: list[int], lengths: np.ndarray) -> None:
        """The ids of the parts that the table numbered last."""
        have = self.index.n - len(lengths)
        while self.n + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.index.n + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[self.n : self.n + len(ids)] = ids
        self.begin[have + 1 : self.index.n + 1] = self.n + np.cumsum(lengths)
        self.n += len(ids)

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of parts of data, encoding the new ones."""
        h = span_hashes(data, start, end)
        h[h == 0] = 1
        out = self.index.find(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            _, once = np.unique(h[new], return_index=True)
            once = new[np.sort(once)]
            raw = data.tobytes()
            ids, lengths = self._encoded([raw[a:b] for a, b in zip(start[once].tolist(), end[once].tolist(), strict=True)])
            self.index.add(h[once])
            self._append(ids, lengths)
            out[new] = self.index.find(h[new])
        return out

    def _lists(self) -> pa.LargeListArray:
        return pa.LargeListArray.from_arrays(pa.array(self.begin[: self.index.n + 1]), pa.array(self.flat[: self.n]))

    def _words(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of each word."""
        data, at = buffers(words)
        start, end = at[:-1], at[1:]
        if not self.closing or not len(data):
            numbers = self._numbers(data, start, end)
            return self._lists().take(pa.array(numbers))
        # Where the closing marks at its end begin, if something solid is before them.
        last = np.maximum.accumulate(np.where(_CLOSES[data], -1, np.arange(len(data))))
        stem = last[np.maximum(end, 1) - 1] + 1
        two = (stem > start) & (stem < end)
        two &= _SOLID[data[np.maximum(stem, 1) - 1]]
        stem = np.where(two, stem, end)
        many = 1 + two
        first = np.cumsum(many) - many
        begins, ends = np.repeat(start, many), np.repeat(end, many)
        ends[first] = stem
        begins[first[two] + 1] = stem[two]
        numbers = self._numbers(data, begins, ends)
        taken = self._lists().take(pa.array(numbers))
        offsets = np.asarray(taken.offsets)[np.append(first, len(begins))]
        return pa.LargeListArray.from_arrays(pa.array(offsets - offsets[0]), taken.values.slice(offsets[0]))

    def _whole(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """For tokenizers that keep white space: each text at once."""
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets, offsets[1:], strict=False)]
        ids = [e.ids + ([] if end is None else [end]) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.cumsum([0, *map(len, ids)])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin (one more than texts). end: an id after each text."""
        if not self.by_word:
            return self._whole(data, offsets, end)
        if self.index.n > self.most:
            self._clear()
        raw = data.tobytes()
        if self.lower:  # fewer different words; special tokens are told by case
            low = raw.lower()
            raw = raw if any(x.encode() in low for x in self.added) else low
        text = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
        split = pc.ascii_split_whitespace(text.view(pa.large_string()))
        coded = pc.dictionary_encode(split.values)
        words, which, first = self._words(coded.dictionary), np.asarray(coded.indices), np.asarray(split.offsets).astype(np.int64)
        if end is not None:  # a word of one id behind each text
            which = np.insert(which, first[1:], len(words))
            first = first + np.arange(len(first))
            words = pa.concat_arrays([words, pa.LargeListArray.from_arrays(pa.array([0, 1], pa.int64()), pa.array([end], pa.int32()))])
        taken = words.take(pa.array(which))
        stop = np.asarray(taken.offsets)
        return np.asarray(taken.values)[stop[0] : stop[-1]], (stop - stop[0])[first]


def encoder(path: str) -> Encoder:
    """One per worker process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
