"""Token ids of whole texts inside a task, with a bounded memory of chunks.

Texts are cut to chunks at places where both public byte-pair tokenizers cut
too: before a run of ASCII white space that follows other characters, and
between an ASCII letter or digit and one of ``.,;:!?``.  So the ids of a text
are the ids of its chunks in a row; ``tests/llm/test_tokens.py`` compares them
with ``Tokenizer.encode`` of the whole text.  Chunks of a batch are found and
hashed (64 bits) with array operations, equal ones are looked up once, and the
tokenizer sees only chunks it hasn't seen lately, run together in one call.
Texts with other white space than ASCII's, or with the string of a special
token (one id, as the library reads it by default), go to the tokenizer whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

# White space of Unicode beyond ASCII's (fixed values, UTF-8), and U+0130, which lower-cases to a letter and a mark
_ODD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]|\xc4\xb0")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_TABLE = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xC2B2AE3D27D4EB4F
_RUN = 4_000             # words run together in a call
BATCH = 600_000          # bytes cut and hashed at once


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        #: strings that the library takes out of a text before anything else
        self.added = {str(t.content): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        strings = [t.encode() for t in self.added]
        self.odd = re.compile(b"|".join([_ODD.pattern, *map(re.escape, strings)]))
        self.odd_pairs = (*_ODD_PAIRS, *{int.from_bytes((t + b"\0")[:2], "big") for t in strings})
        #: white space is dropped and words carry an end mark, or spaces belong to the words after them
        self.end_mark = self.tokenizer.model.end_of_word_suffix
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        flag = (lambda p: p.endswith(self.end_mark)) if self.end_mark else (lambda p: p[0] == "Ġ")
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for p, i in vocab.items() if flag(p)]] = True
        self.limit = limit
        self._reset()
        self.up = self.down = np.ones(1, np.uint64)

    def _reset(self) -> None:
        self.names = np.zeros(0, np.uint64)  # hashes of the remembered chunks, ascending
        self.spans = np.zeros((0, 2), np.int64)  # of each, the first id and the number of ids in ``pool``
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def encode(self, text: str) -> bytes:
        return self.encode_many([text.encode()])[0]

    def encode_many(self, texts: Iterable[bytes | None]) -> list[bytes]:
        """Ids of each UTF-8 text, 4 bytes each; null counts as empty, broken UTF-8 as U+FFFD."""
        out: list[bytes] = []
        part: list[bytes] = []
        held = 0
        for t in texts:
            t = t or b""
            part.append(t)
            held += len(t) + 1
            if held >= BATCH:
                out += self._batch(part)
                part, held = [], 0
        return out + self._batch(part) if part else out

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        odd = {i: t for i, t in enumerate(texts) if self.odd.search(t)} if _any_odd(b"".join(texts), self.odd_pairs) else {}
        got = None
        if not odd:
            try:
                got = self._plain(texts)
            except UnicodeDecodeError:
                odd = {i: t for i, t in enumerate(texts) if not _is_utf8(t)}
        if odd:
            got = self._plain([b"" if i in odd or not _is_utf8(t) else t for i, t in enumerate(texts)])
            odd = {i: t for i, t in enumerate(texts) if i in odd or not _is_utf8(t)}
            for i, x in zip(odd, self._whole([t.decode("utf-8", "replace") for t in odd.values()])):
                got[i] = x
        return got

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that aren't cut."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _cuts(self, texts: list[bytes], buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the chunks; none spans two texts."""
        space = _SPACE[buf]
        before = np.append(True, space[:-1])  # a text's first byte counts as after a space
        begins = ends - np.fromiter(map(len, texts), np.int64, len(texts))
        first = begins[begins < ends]
        mark = _MARK[buf]
        mark[1:] &= _ALNUM[buf[:-1]]
        mark[:1] = False
        if self.end_mark:  # white space is dropped
            start = ~space & before
            start |= mark
            start[first] = ~space[first]
            stop = ~space & np.append(space[1:], True)
            stop[:-1] |= mark[1:] & ~space[:-1]
            last = ends[begins < ends] - 1
            stop[last] = ~space[last]
            return np.flatnonzero(start), np.flatnonzero(stop) + 1
        start = space & ~before  # a run of white space belongs to what follows it
        start |= mark
        start[first] = True
        at = np.flatnonzero(start)
        return at, np.append(at[1:], len(buf))

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        raw = b"".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not len(buf):
            return [b""] * len(texts)
        if len(self.names) > self.limit:
            self._reset()
        start, end = self._cuts(texts, buf, ends)
        if len(self.up) <= len(buf):
            n = len(buf) + 1
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)))
                                  for b in (_BASE, pow(_BASE, -1, 2**64)))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * self.up[:len(buf)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.down[start]
        h ^= (h >> np.uint64(29)) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        names, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            a, b = start[where[new]].tolist(), end[where[new]].tolist()
            self._store(at[new], names[new], self._learn([raw[x:y].decode() for x, y in zip(a, b)]))
            at = np.searchsorted(self.names, names)
        span = self.spans[at][inverse]
        size = span[:, 1]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        tokens = self.pool[np.repeat(span[:, 0] - (upto - size), size) + np.arange(total)].tobytes()
        chunk = np.append(0, np.searchsorted(start, ends))  # chunks before each text's end
        cut = (4 * np.append(0, upto)[chunk]).tolist()
        return [tokens[x:y] for x, y in zip(cut, cut[1:])]

    def _store(self, at: np.ndarray, names: np.ndarray, ids: list[bytes]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(flat)] = flat
        spans = np.stack([self.used + np.cumsum(sizes) - sizes, sizes], 1)
        self.used += len(flat)
        self.names = np.insert(self.names, at, names)
        self.spans = np.insert(self.spans, at, spans, axis=0)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that aren't remembered."""
        out: list[bytes | None] = [None] * len(chunks)
        if self.end_mark:
            words = [i for i, c in enumerate(chunks) if c.isalpha()]
        else:
            words = [i for i, c in enumerate(chunks) if c[0] == " " and c[1:].isalpha()]
        for at in range(0, len(words), _RUN):
            part = words[at:at + _RUN]
            got = self._run([chunks[i] for i in part])
            if got is not None:  # else a letter turned into two pre-tokens: one by one
                for i, x in zip(part, got):
                    out[i] = x
        others = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(others), 5_000):
            part = others[at:at + 5_000]
            for i, x in zip(part, self._whole([chunks[i] for i in part])):
                out[i] = x
        return out

    def _run(self, words: list[str]) -> list[bytes] | None:
        """Ids of each of ``words`` (letters only) from one call."""
        text = " ".join(words) if self.end_mark else "".join(words)
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return None
        raw = ids.tobytes()
        cuts = np.append(0, at + 1) * 4 if self.end_mark else np.append(at, len(ids)) * 4
        cuts = cuts.tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_ODD_PAIRS = (0xC285, 0xC2A0, 0xC4B0, 0xE19A, 0xE280, 0xE281, 0xE380)  # how the longer ones begin


def _any_odd(raw: bytes, pairs: tuple[int, ...] = _ODD_PAIRS) -> bool:
    """Whether a batch may hold an odd string that begins so (array comparisons; the expression is only run where this says so)."""
    b = np.frombuffer(raw + b"\0\0", np.uint8)
    low = b[:-2]
    if ((low - np.uint8(0x1C)) < 4).any():
        return True
    pair = low.astype(np.uint16) << 8 | b[1:-1]
    return any((pair == x).any() for x in pairs)


@functools.cache
def shared(path: str) -> ChunkIds:
    """The worker process's own memory for a tokenizer."""
    return ChunkIds(path)


def text_of(raw: bytes | None) -> str:
    """UTF-8 text of a binary column; null is empty, broken bytes become U+FFFD."""
    return raw.decode("utf-8", "replace") if raw else ""
