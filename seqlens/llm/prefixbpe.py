"""Byte-pair encoding by a dynamic programme over prefixes, and decoding (operator 13).

Every prefix of a word has one encoding, so it has one last token; and a row of
tokens is an encoding exactly if each two neighbours are *compatible*, that is
if no merge would cross the border between them.  So for each prefix, in order,
the vocabulary's tokens that end there are tried, and the only one which is
compatible with the last token of the prefix before it is stored.  Following
these from the word's end gives the ids.

* **Tokens that end at a place** come from an automaton over the vocabulary:
  its state is the longest suffix of the prefix that begins some token, each
  state knows the longest token that is a suffix of it, and each token the next
  shorter one.
* **Compatibility** compares life spans.  A token is built by merges of rising
  rank; the parts at its right edge (left edge) exist one after another, each
  from the rank that builds it to the rank that uses it up.  Two tokens are
  incompatible if two edge parts that exist at the same time have a merge which
  comes before either is used up (of equal merges the left one comes first).

All words that a batch of texts brings anew go through the programme together,
position by position, with array operations; ``tokens.ChunkIds`` finds chunks
and remembers their ids within a bound.  The rules before the programme (NFC,
lower case, white space, the pre-tokens' pattern) are the tokenizer file's own,
run by the tokenizers library; its encoder isn't used.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.base import narrow, numbers, tidy
from seqlens.llm.tokens import ChunkIds, tokenizer_path

LONG = 48            # symbols from which a word is run alone
KNOWN_PAIRS = 1 << 20  # compatibility answers kept (a newer one replaces an older one)
_NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    letters.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)})
    return [letters[b] for b in range(256)]


class Merges:
    """Vocabulary and merges as arrays: parts, ranks, automaton."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_mark: str):
        size = max(vocab.values()) + 1
        self.size = size
        letters = byte_letters()
        self.plain = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end_mark] for c in letters], np.int64) if end_mark else self.plain
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.birth = np.full(size, -1, np.int64)
        spelled: dict[int, tuple[int, ...]] = {int(s): (int(s),) for s in {*self.plain.tolist(), *self.final.tolist()}}
        pairs = np.empty(len(merges), np.int64)
        for rank, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if i not in spelled or j not in spelled or k in spelled:
                raise ValueError(f"merge {rank} uses a token that later merges build, or builds one anew")
            spelled[k] = spelled[i] + spelled[j]
            self.left[k], self.right[k], self.birth[k], pairs[rank] = i, j, rank, i * size + j
        self.rank = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.rank]
        self.length = np.zeros(size, np.int64)
        for t, s in spelled.items():
            self.length[t] = len(s)
        built = np.array([vocab[a + b] for a, b in merges], np.int64)
        whole = np.ones(size, bool)  # tokens that encode to themselves
        if len(built):
            fits = ~self.crossed(self.left[built], self.right[built], np.arange(len(built), dtype=np.int64))
            for t, ok, a, b in zip(built.tolist(), fits.tolist(), self.left[built].tolist(), self.right[built].tolist()):
                whole[t] = ok and whole[a] and whole[b]
        self._automaton({t: s for t, s in spelled.items() if whole[t]})
        self.asked = np.full(KNOWN_PAIRS, -1, np.int64)
        self.answer = np.zeros(KNOWN_PAIRS, bool)

    def _automaton(self, spelled: dict[int, tuple[int, ...]]) -> None:
        child: list[dict[int, int]] = [{}]
        token = [-1]
        for t, s in spelled.items():
            at = 0
            for c in s:
                nxt = child[at].get(c)
                if nxt is None:
                    nxt = child[at][c] = len(child)
                    child.append({})
                    token.append(-1)
                at = nxt
            token[at] = t
        back = [0] * len(child)
        longest = token[:]              # the longest token that is a suffix of the state
        shorter = np.full(self.size, -1)
        layer = list(child[0].values())
        while layer:                    # by length, so that shorter states are done
            following = []
            for state in layer:
                down = longest[back[state]]
                if token[state] >= 0:
                    shorter[token[state]] = down
                else:
                    longest[state] = down
                for c, nxt in child[state].items():
                    f = back[state]
                    while f and c not in child[f]:
                        f = back[f]
                    back[nxt] = child[f].get(c, 0)
                    following.append(nxt)
            layer = following
        self.child = child
        self.back, self.longest, self.shorter = np.array(back), np.array(longest), shorter
        edges = sorted((state * self.size + c, nxt) for state, d in enumerate(child) for c, nxt in d.items())
        self.edges = np.array([e for e, _ in edges], np.int64)
        self.target = np.array([n for _, n in edges], np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one more symbol each."""
        out = np.zeros(len(state), np.int64)
        todo, now = np.arange(len(state)), state
        while len(todo):
            key = now * self.size + symbol[todo]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            out[todo[hit]] = self.target[at[hit]]
            on = ~hit & (now > 0)
            todo, now = todo[on], self.back[now[on]]
        return out

    def crossed(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge before ``until`` crosses the border of tokens ``a`` and ``b``."""
        out = np.zeros(len(a), bool)
        todo, x, y = np.arange(len(a)), a, b
        ends_x = np.full(len(a), _NEVER) if until is None else until
        ends_y = ends_x
        while len(todo):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            m = np.where(self.pairs[at] == key, self.rank[at], _NEVER)
            # of equal merges the left one comes first: it has used x up by then, but not y
            hit = (m < ends_x) & (m <= ends_y)
            out[todo[hit]] = True
            bx, by = self.birth[x], self.birth[y]
            go = ~hit & ((bx >= 0) | (by >= 0))
            todo, x, y, ends_x, ends_y, bx, by = (v[go] for v in (todo, x, y, ends_x, ends_y, bx, by))
            later = bx > by              # back in time: the part built last comes apart first
            x, ends_x = np.where(later, self.right[x], x), np.where(later, bx, ends_x)
            y, ends_y = np.where(later, y, self.left[y]), np.where(later, ends_y, by)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) % KNOWN_PAIRS
        new = self.asked[slot] != key
        out = self.answer[slot]
        if new.any():
            names, inverse = np.unique(key[new], return_inverse=True)
            fits = ~self.crossed(names // self.size, names % self.size)
            out[new] = fits[inverse]
            self.asked[slot[new]] = key[new]
            self.answer[slot[new]] = out[new]
        return out

    def last_tokens(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each prefix of each word (``size`` symbols from ``begin`` on, the longest words first) its last token."""
        last = np.full(len(symbols), -1, np.int64)
        state = np.zeros(len(begin), np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, side="left"))  # words with more than i symbols
            at = begin[:n] + i
            state = self.step(state[:n], symbols[at])
            token = self.longest[state]
            todo = np.arange(n)
            while len(todo):
                before = i - self.length[token]
                fits = before < 0
                inner = np.flatnonzero(~fits)
                if len(inner):
                    prev = last[begin[todo[inner]] + before[inner]]
                    fits[inner] = self.compatible(prev, token[inner])
                last[at[todo[fits]]] = token[fits]
                todo, token = todo[~fits], self.shorter[token[~fits]]
        return last

    def _alone(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long word, by plain steps."""
        word, child, back = symbols.tolist(), self.child, self.back
        longest, shorter, length = self.longest, self.shorter, self.length
        known: dict[tuple[int, int], bool] = {}
        last: list[int] = []
        state = 0
        for i, c in enumerate(word):
            while state and c not in child[state]:
                state = int(back[state])
            state = child[state].get(c, 0)
            token = int(longest[state])
            while True:
                before = i - int(length[token])
                if before < 0:
                    break
                pair = (last[before], token)
                if pair not in known:
                    if len(known) >= KNOWN_PAIRS:
                        known.clear()
                    known[pair] = bool(self.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
                if known[pair]:
                    break
                token = int(shorter[token])
            last.append(token)
        return np.array(last, np.int64)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (its bytes)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.plain[np.frombuffer(b"".join(words), np.uint8)]
        end = np.cumsum(size)
        begin = end - size
        some = size > 0
        symbols[end[some] - 1] = self.final[np.frombuffer(b"".join(words), np.uint8)[end[some] - 1]]
        last = np.empty(len(symbols), np.int64)
        order = np.argsort(-size, kind="stable")
        long = int(np.searchsorted(-size[order], -LONG, side="left"))
        for w in order[:long]:
            last[begin[w]:end[w]] = self._alone(symbols[begin[w]:end[w]])
        rest = order[long:]
        short = self.last_tokens(symbols, begin[rest], size[rest])
        last = np.where(short >= 0, short, last) if len(symbols) else last
        # back from each word's end; a token is written where it begins
        ids = np.full(len(symbols), -1, np.int64)
        at = end[some] - 1
        stop = begin[some]
        while len(at):
            token = last[at]
            first = at - self.length[token] + 1
            ids[first] = token
            go = first > stop
            at, stop = first[go] - 1, stop[go]
        kept = ids >= 0
        cut = np.append(0, np.cumsum(kept))
        flat = ids[kept].astype(np.uint32)
        a, b = cut[begin].tolist(), cut[end].tolist()
        return [flat[x:y] for x, y in zip(a, b)]


class PrefixIds(ChunkIds):
    """Ids of texts by the prefix programme, and texts of ids."""

    def __init__(self, path: str, limit: int = 1_500_000):
        super().__init__(path, limit)
        import json
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain byte-pair model: {model['type']} {odd}")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder for {kind}")
        self.joint = b" " if kind is None else b""   # without a decoder the library puts spaces between tokens
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        if kind is None:
            table = [names.get(i, "").encode() for i in range(max(names) + 1)]
        else:
            table = [bytes(self.byte_of[c] for c in names.get(i, "")) if all(c in self.byte_of for c in names.get(i, ""))
                     else names[i].encode() for i in range(max(names) + 1)]
        self.known = np.array([i in names for i in range(len(table))])
        sizes = np.array([len(t) + len(self.joint) for t in table], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.letters = np.frombuffer(b"".join(t + self.joint for t in table), np.uint8)

    def _words(self, text: str) -> list[bytes]:
        """The pre-tokens of a text without special tokens, as bytes."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [bytes(self.byte_of[c] for c in w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        words: list[list[bytes]] = [[]] * len(chunks)
        letters = []
        for i, c in enumerate(chunks):
            if self.end_mark and c.isalpha():
                if c.isascii():
                    words[i] = [c.lower().encode()]
                else:
                    letters.append(i)
            else:
                words[i] = self._words(c)
        got = self._words(" ".join(chunks[i] for i in letters))
        if len(got) == len(letters):   # else a letter turned into two pre-tokens: one by one
            for i, w in zip(letters, got):
                words[i] = [w]
        else:
            for i in letters:
                words[i] = self._words(chunks[i])
        return self._joined(words)

    def _joined(self, words: list[list[bytes]]) -> list[bytes]:
        ids = [x.tobytes() for x in self.merges.encode([w for ws in words for w in ws])]
        out, at = [], 0
        for ws in words:
            out.append(ids[at] if len(ws) == 1 else b"".join(ids[at:at + len(ws)]))
            at += len(ws)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            marks = [np.array([self.added[m]], np.uint32).tobytes() for m in self.special.findall(t)]
            parts = self._joined([self._words(p) for p in self.special.split(t)])
            out.append(b"".join(x for pair in zip(parts, [*marks, b""]) for x in pair))
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of little-endian unsigned 32-bit ids; unknown ids are left out."""
        i = np.frombuffer(ids, np.uint32).astype(np.int64)
        i = i[i < len(self.known)]
        i = i[self.known[i]]
        size = self.ends[i] - self.begins[i]
        upto = np.cumsum(size)
        if not len(i):
            return b""
        raw = self.letters[np.repeat(self.begins[i] - (upto - size), size) + np.arange(upto[-1])].tobytes()
        return raw[:-1] if self.joint else raw.decode("utf-8", "replace").encode()


@functools.cache
def shared(path: str) -> PrefixIds:
    """The worker process's own memory for a tokenizer."""
    return PrefixIds(path)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  with_data: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row, and with ``with_data`` also ``ids`` and ``decoded``.

    ``ids`` are little-endian unsigned 32-bit ids, ``decoded`` the text that the
    library decodes from them.  A null text counts as empty (no ids, empty
    text); null and repeated ids give a row each; the string of a special token
    in a text is that token.  Broken UTF-8 counts as U+FFFD.  An empty table
    gives an empty result; extra columns may have any name.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    @tidy
    def run(frames):
        tool = shared(path)
        for pdf in frames:
            texts = [None if t is None else bytes(t) for t in pdf["text"]]
            held, at = 0, 0
            for k, t in enumerate(texts, 1):  # parts of bounded size
                held += len(t or b"")
                if held < 4_000_000 and k < len(texts):
                    continue
                rows = []
                for ids in tool.encode_many(texts[at:k]):
                    text = tool.decode(ids)
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())
                    rows.append(row + (ids, text) if with_data else row)
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_data)
                out.insert(0, "doc_id", numbers(pdf["id"].iloc[at:k]))
                yield out
                held, at = 0, k

    rows = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("long").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInPandas(run, OUT + (", ids binary, decoded binary" if with_data else ""))
    return out.withColumn("decoded", F.col("decoded").cast("string")) if with_data else out
