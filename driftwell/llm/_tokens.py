"""Token ids of many texts, through a cache of chunks.

Both vocabularies split a text before each run of white space, so the ids of a text are
the ids of its chunks (white space and what follows up to the next white space), one after
the other. A batch of texts is cut into chunks and these are numbered by Arrow and numpy;
usual punctuation after a word of letters is numbered apart, because what is not a letter
begins another unit. Each worker keeps the ids of the stems seen lately in sorted arrays,
under 128-bit hashes, and asks the tokenizers library for the others.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Stems that a worker keeps; beyond, the half used least lately goes.
KEPT = 250_000
#: Bytes of text that go through at once.
GROUP = 4_000_000
_LOADED: dict[str, CachedEncoder] = {}
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PUNCTUATION = ".,;:!?"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, spaced: bool) -> CachedEncoder:
    """The worker's encoder for a vocabulary file; it outlives the task."""
    if path not in _LOADED:
        _LOADED[path] = CachedEncoder(path, spaced)
    return _LOADED[path]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes bytes as: themselves if printable, else those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    s = _SPACE[data]
    for at in np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)).tolist() if (data > 0xC1).any() else ():
        width = 2 if data[at] == 0xC2 else 3
        c = bytes(data[at : at + width]).decode("utf-8", "replace")
        if len(c) == 1 and c.isspace():
            s[at : at + width] = True
    return s


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts on end, and where each text's begin (one more at the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    at = at - at[0]
    s = white_space(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = s[1:] & ~s[:-1] if len(data) else cut[1:-1]
    cut[at] = True
    cut[-1] = True
    where = np.flatnonzero(cut)
    begin = np.searchsorted(where, at)
    empty = pa.LargeStringArray.from_buffers(len(where) - 1, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return empty, begin


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where runs of texts of at most ``GROUP`` bytes begin, and how many texts they have; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + GROUP, side="right")))
        yield i, j - i
        i = j


class CachedEncoder:
    """``spaced``: the white space before a word belongs to its tokens (byte-level BPE); otherwise white space and case are dropped.

    Ids are those of the library's own ``encode(text, add_special_tokens=False)``. A text that
    holds the string of an added token (``<|endoftext|>``) has that token's id there, and goes to the
    library whole, as what stands beside such a string does not split into chunks.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters, self.spaced, self.turn = self.tokenizer.model, _byte_letters(), spaced, 0
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begin, self.size, self.used = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end (unsigned 32-bit), and where each text's begin (one more at the end)."""
        ids, at, done = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for i, n in _groups(texts):
            x, a = self._group(texts.slice(i, n))
            ids.append(x)
            at.append(a[1:] + done)
            done += len(x)
        return np.concatenate(ids), np.concatenate(at)

    def slices(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """A batch with a column ``text`` in slices of about ``GROUP`` bytes of it (a longer text is a slice of its own), each with what ``encode`` gives for its texts; at most two are held at once."""
        for i, n in _groups(batch.column("text")):
            part = batch.slice(i, n)
            yield part, *self._group(part.column("text"))
        pa.default_memory_pool().release_unused()

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(len(texts), bool)
        for t in self.added:  # in any case, as a vocabulary may match after its normalizer
            whole |= pc.fill_null(pc.match_substring(texts, t, ignore_case=True), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode(texts)
        rest, at = self._encode(pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts))
        made = self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
        n = np.diff(at)
        n[whole] = [len(e.ids) for e in made]
        ids, at = np.empty(int(n.sum()), np.uint32), np.concatenate([[0], np.cumsum(n)])
        ids[np.repeat(~whole, n)] = rest
        for i, e in zip(np.flatnonzero(whole).tolist(), made, strict=True):
            ids[at[i] : at[i + 1]] = e.ids
        return ids, at

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, begin = chunks(texts)
        coded = parts.dictionary_encode()
        words, number = coded.dictionary, coded.indices.to_numpy()
        if not self.spaced:
            words = pc.ascii_lower(pc.utf8_trim_whitespace(words))
        stems, tails = self._split(words)
        every = pa.concat_arrays([stems, tails.dictionary]).dictionary_encode()
        each = every.indices.to_numpy()
        first, size, store = self._of(every.dictionary)
        # a word is its stem's ids and then its tail's
        stem, tail = each[: len(stems)], each[len(stems) :][tails.indices.to_numpy()]
        size_of, starts = size[stem] + size[tail], np.empty(len(stem) + 1, np.int64)
        starts[0], starts[1:] = 0, np.cumsum(size_of)
        flat = np.empty(starts[-1], store.dtype)
        _copy(store, first[stem], size[stem], flat, starts[:-1])
        _copy(store, first[tail], size[tail], flat, starts[:-1] + size[stem])
        n = size_of[number]
        ends = np.empty(len(n) + 1, np.int64)
        ends[0], ends[1:] = 0, np.cumsum(n)
        ids, block = np.empty(ends[-1], np.uint32), 200_000
        for i in range(0, len(n), block):
            j = min(i + block, len(n))
            shift = (starts[number[i:j]] - (ends[i:j] - ends[i])).astype(np.int32)
            ids[ends[i] : ends[j]] = flat[np.repeat(shift, n[i:j]) + np.arange(ends[j] - ends[i], dtype=np.int32)]
        return ids, ends[begin]

    def _split(self, words: pa.Array) -> tuple[pa.Array, pa.DictionaryArray]:
        """Words of letters without the usual punctuation after them, and that; other chunks whole, with nothing after them."""
        stems = pc.utf8_rtrim(words, characters=_PUNCTUATION)
        letters = pc.utf8_is_alpha(pc.utf8_ltrim(stems, characters=" ") if self.spaced else stems)
        tails = pc.binary_slice(words.cast(pa.large_binary()), 0, 0)
        cut = pc.and_(letters, pc.not_equal(pc.binary_length(words), pc.binary_length(stems)))
        if pc.any(cut).as_py():
            own = words.filter(cut)
            ends = pa.array([w[len(s) :] for w, s in zip(own.to_pylist(), stems.filter(cut).to_pylist(), strict=True)], pa.large_string())
            tails = pc.replace_with_mask(tails.cast(pa.large_string()), cut, ends)
        return pc.if_else(letters, stems, words), tails.cast(pa.large_string()).dictionary_encode()

    def _of(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each stem, where its ids are in the store and how many; and the store."""
        self.turn += 1
        names = stems.to_numpy(zero_copy_only=False).astype(object)
        key = pd.util.hash_array(names, hash_key="driftwell-stem-1", categorize=False)
        check = pd.util.hash_array(names, hash_key="driftwell-stem-2", categorize=False)
        order = np.argsort(key)
        at = np.empty(len(key), np.int64)
        at[order] = np.searchsorted(self.key, key[order])
        known = np.zeros(len(key), bool)
        some = np.flatnonzero(at < len(self.key))
        known[some] = (self.key[at[some]] == key[some]) & (self.check[at[some]] == check[some])
        first, size = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        old = at[known]
        first[known], size[known], self.used[old] = self.begin[old], self.size[old], self.turn
        new = order[~known[order]]
        made = self._new(names[new].tolist())
        n = np.fromiter(map(len, made), np.int32, len(made))
        begin = len(self.ids) + np.cumsum(n) - n
        first[new], size[new] = begin, n
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in made for i in x), self.ids.dtype, int(n.sum()))])
        store = self.ids
        where = at[new]
        self.key, self.check = np.insert(self.key, where, key[new]), np.insert(self.check, where, check[new])
        self.begin, self.size, self.used = np.insert(self.begin, where, begin), np.insert(self.size, where, n), np.insert(self.used, where, self.turn)
        if len(self.key) > KEPT:
            self._drop_half()
        return first, size, store

    def _drop_half(self) -> None:
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2 :])
        n = self.size[keep].astype(np.int64)
        starts = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), self.ids.dtype)
        _copy(self.ids, self.begin[keep], n, ids, starts)
        self.key, self.check, self.size, self.used, self.begin, self.ids = self.key[keep], self.check[keep], self.size[keep], self.used[keep], starts, ids

    def _new(self, stems: list[str]) -> list[list[int]]:
        """The ids of stems that the worker doesn't hold; words of letters go to the model as one unit each."""
        out: list = [None] * len(stems)
        tokenize, spaced, other = self.model.tokenize, self.spaced, []
        for k, s in enumerate(stems):
            if s.isascii() and (s[1:] if spaced and s[:1] == " " else s).isalpha():
                out[k] = [t.id for t in tokenize("\u0120" + s[1:] if s[:1] == " " else s)]
            elif (s[1:] if spaced and s[:1] == " " else s).isalpha() and (spaced or (s.islower() and unicodedata.is_normalized("NFC", s))):
                out[k] = [t.id for t in tokenize(s.encode().decode("latin-1").translate(self.letters))]
            else:
                other.append(k)
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([stems[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out


def _copy(source: np.ndarray, first: np.ndarray, size: np.ndarray, out: np.ndarray, to: np.ndarray) -> None:
    """``out[to[i] : to[i] + size[i]] = source[first[i] : first[i] + size[i]]`` for all i."""
    block = 200_000
    for i in range(0, len(size), block):
        n = size[i : i + block].astype(np.int64)
        ends = np.cumsum(n)
        k = np.arange(int(ends[-1])) - np.repeat(ends - n, n) if len(n) else np.empty(0, np.int64)
        out[np.repeat(to[i : i + block], n) + k] = source[np.repeat(first[i : i + block], n) + k]
