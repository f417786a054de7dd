"""Public tokenizers, applied to whole texts through a cache of their independent units.

A unit is a stretch of text that the tokenizer treats by itself wherever it stands: it never joins
symbols across the unit's ends. Units repeat a lot, so each worker asks the library once for each
distinct unit and puts a text's result together from them. A text with anything that could make
units depend on each other is given to the library whole; both ways give the library's own ids.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
#: Bytes that begin what could make units depend on each other: control characters, "<" of "<|", first bytes of other white space.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Places for known units, 32 MB; a unit that falls to another's place takes it over.
SLOTS = 1 << 21
#: Ids of known units beyond which a worker starts again.
POOL_IDS = 1 << 23
#: Known units in a dictionary beyond which a worker starts again.
CACHE_UNITS = 300_000
#: Units that the library gets at a time.
_TOGETHER = 100


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Units:
    """encode(list of texts) -> for each, the values of its units, or of itself, in order."""

    def __init__(self, split: Callable[[str], list[str] | None], values: Callable[[list[str]], list], whole: Callable[[str], object]):
        self.split, self.values, self.whole, self.cache = split, values, whole, {}

    def __call__(self, texts: list[str]) -> Iterator[list]:
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        lists = [self.split(t) if t else [] for t in texts]
        missing = list(set().union(*(x for x in lists if x)).difference(self.cache))
        self.cache.update(zip(missing, self.values(missing), strict=True))
        get = self.cache.__getitem__
        for t, units in zip(texts, lists, strict=True):
            yield [self.whole(t)] if units is None else list(map(get, units))


def _split_pieces(text: str) -> list[str] | None:
    """For a piece model whose pieces hold the space mark at their start only."""
    if "▁" in text or "\0" in text:
        return None
    text = text.replace("\n", " \n")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return None
    return text.split(" ")


class IdEncoder:
    """encode(bytes, offsets of texts) -> (ids, offsets of ids), as the library gives them for each whole text.

    Units are byte ranges, found and hashed for a whole batch at once. Known units have a place by their
    hash, which says where in one array their ids begin and how many they are.

    For a tokenizer that drops white space (word_*), units are words. For byte-level BPE behind a
    pattern that gives a word the one space before it, they tile the text: a word with its one space,
    a line end by itself. In both, a full stop or comma after a Latin letter and before white space
    is a unit of its own, as both patterns part letters from punctuation. A text in which
    white space meets white space or an end of the text, or with other white space than 0x20 and
    0x0A, or with what could be a special token, is one unit: itself.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary(name))
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.words_only = name.startswith("word_")
        #: What stands between units that are encoded together: byte-level patterns make a line end a token
        #: of its own; where white space is dropped, a control character between spaces does.
        self.between = b" \x01 " if self.words_only else b"\n"
        (self.mark,) = self.tok.encode(self.between.decode(), add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from skein.llm import texts

        starts, ends, whole = self._units(data, offsets)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        h = texts.word_hashes(data, starts, ends, False)
        h[h == 0] = 1
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != h)
        begin, n = self.begin[slot].astype(np.int64), self.size[slot].astype(np.int64)
        if len(new):
            distinct, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            a, b = starts[new[first]], ends[new[first]]
            alone = whole[np.searchsorted(offsets, a, "right") - 1]
            if not self.words_only:
                alone |= data[a] == 0x0A
            elif (marks := data == 0x01).any():
                before = np.concatenate([[0], np.cumsum(marks)])
                alone |= before[b] > before[a]
            got, size = self._encoded(data, a, b, alone)
            if self.used + len(got) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + len(got), self.kind)])
            self.pool[self.used : self.used + len(got)] = got
            at = self.used + np.cumsum(size) - size
            self.used += len(got)
            begin[new], n[new] = at[inverse], size[inverse]
            to = slot[new[first]]
            self.keys[to], self.begin[to], self.size[to] = distinct, at, size
        to = np.concatenate([[0], np.cumsum(n)])
        out = self.pool[np.arange(to[-1]) + np.repeat(begin - to[:-1], n)]
        if self.used > POOL_IDS:
            self._forget()
        return out, to[np.searchsorted(starts, offsets)]

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each unit's ids). Units that aren't marked alone go to the library some at a time,
        parted by white space that the tokenizer splits at and that gives, or holds, one id of its own."""
        size = np.empty(len(starts), np.int64)
        ids, apart = [], np.flatnonzero(~alone)
        for i in range(0, len(apart), _TOGETHER * 100):
            part = apart[i : i + _TOGETHER * 100]
            n = ends[part] - starts[part] + len(self.between)
            to = np.concatenate([[0], np.cumsum(n)])
            text = data[np.minimum(np.arange(to[-1]) + np.repeat(starts[part] - to[:-1], n), len(data) - 1)]
            for j, byte in enumerate(self.between):
                text[to[1:] - len(self.between) + j] = byte
            cuts = to[::_TOGETHER].tolist() if (len(to) - 1) % _TOGETHER == 0 else [*to[::_TOGETHER].tolist(), int(to[-1])]
            found = self.tok.encode_batch_fast([text[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)
            got = np.concatenate([np.array(e.ids, self.kind) for e in found])
            mark = got == self.mark
            at = np.flatnonzero(mark)
            if len(at) != len(part):
                raise ValueError("a unit's ids can't be told from the next one's")
            size[part] = np.diff(at, prepend=-1) - 1
            ids.append(got[~mark])
        rest = np.flatnonzero(alone)
        lists = [e.ids for e in self.tok.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)], add_special_tokens=False)]
        size[rest] = [len(x) for x in lists]
        ids.append(np.array([i for x in lists for i in x], self.kind))
        # ids stand in the order of apart, then rest; back to the order of the units
        order = np.concatenate([apart, rest])
        begin = np.empty(len(starts), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        to = np.cumsum(size) - size
        return np.concatenate(ids)[np.arange(size.sum()) + np.repeat(begin - to, size)], size

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, for each text whether it is one unit)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        space = _ASCII_SPACE[data]
        next_space = edge[1:].copy()
        next_space[:-1] |= space[1:]
        whole = np.zeros(len(offsets) - 1, bool)
        at = np.flatnonzero(_SUSPECT[data])
        byte, after, third = data[at], data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]
        after[at == n - 1] = 0
        odd = (byte == 0x3C) & (after == 0x7C)
        if not self.words_only:
            odd |= byte < 0x20
            odd |= (byte == 0xC2) & ((after == 0x85) | (after == 0xA0))
            odd |= ((byte == 0xE1) & ((after == 0x9A) | (after == 0xA0))) | ((byte == 0xE3) & (after == 0x80) & (third == 0x80))
            odd |= (byte == 0xE2) & (((after == 0x80) & ((third <= 0x8B) | ((third >= 0xA8) & (third <= 0xAF)))) | (after == 0x81))
            gaps = np.flatnonzero(space & (next_space | edge[:-1]))
            whole[np.searchsorted(offsets, gaps, "right") - 1] = True
        whole[np.searchsorted(offsets, at[odd], "right") - 1] = True
        stop = np.flatnonzero(_STOP[data])
        stop = stop[(stop > 0) & _LETTER[data[stop - 1]] & next_space[stop] & ~edge[stop]]
        if whole.any():
            stop = stop[~whole[np.searchsorted(offsets, stop, "right") - 1]]
            for i in np.flatnonzero(whole):
                space[offsets[i] : offsets[i + 1]] = False
        begins = np.zeros(n, bool)
        begins[stop] = True
        if self.words_only:
            begins[1:] |= ~space[1:] & (space[:-1] | edge[1:n])
            begins[0] |= not space[0]
            starts = np.flatnonzero(begins)
            closes = ~space
            closes[:-1] &= space[1:] | edge[1:n]
            closes[stop - 1] = True
            return starts, np.flatnonzero(closes) + 1, whole
        begins |= space
        begins |= edge[:n]
        line = np.flatnonzero(space & (data == 0x0A)) + 1
        begins[line[line < n]] = True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], n), whole


def count_units(name: str) -> Units:
    """Units whose values are numbers of tokens, for a piece model (.model)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))

    def values(units: list[str]) -> list[int]:
        # a unit that begins with a line end has no space before it: one token more stands for that
        after = [u[0] == "\n" for u in units]
        got = sp.encode(["x" + u if a else u for u, a in zip(units, after, strict=True)], num_threads=1)
        return [len(x) - a for x, a in zip(got, after, strict=True)]

    return Units(_split_pieces, values, lambda t: len(sp.encode(t, num_threads=1)))


@functools.cache
def encoder(name: str) -> IdEncoder:
    """This process's encoder. Tasks call it by the module's name, so that a worker keeps it for its next task; a
    table in a module of the task's own function would be sent along with each task, empty."""
    return IdEncoder(name)


@functools.cache
def counter(name: str) -> Units:
    """This process's count_units(name)."""
    return count_units(name)


def version(name: str) -> str:
    """Digest of a tokenizer: its file and its library's version."""
    import hashlib
    import importlib.metadata

    library = "tokenizers" if name.endswith(".json") else "sentencepiece"
    with open(vocabulary(name), "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()
