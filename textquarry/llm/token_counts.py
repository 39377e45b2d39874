"""Token counts at every prefix of a text, by prefix dynamic programming.

``TokenPrefixes`` reads the merges of a byte-level BPE with word ends. For each prefix of a word it keeps the last
token of that prefix's encoding and the number of tokens; the entry for a longer prefix follows from a shorter one and
the one token that may stand after it. A token may follow another if encoding both together gives just those two.
The unseen words of a slice of rows are settled together, letter by letter, over the tree of their prefixes with numpy.
A text's table is the joined tables of its words, each entry the change of the count at a code point, so that running
sums answer truncation and budget questions by look-up, without encoding again.

Positions are code points of the normalised text (for Latin-1 texts these are the positions of the text itself).

Cases: null text counts as empty; an empty text has no tokens and no prefixes; strings of special tokens inside a text
count as the library counts them by default, one token each; repeated rows give repeated results; an empty table gives
an empty table; very long texts are read in parts that end after white space; a column named like a result is replaced
in the output and kept out of the count.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Pieces, per_value, table

#: White space, letters and numbers of Latin-1, in which plain ``re`` splits as the tokenizer's own pattern does.
_WS, _L, _N = "\t-\r \x85\xa0", "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"(?:'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_WS}{_L}{_N}]+)[{_WS}]*|[{_WS}]+")
_BREAK = re.compile("[ \n](?=[a-zA-Z])")
#: Code points of a text that are in pieces at once.
PART = 1 << 20
#: Words up to this length are kept and settled together; longer ones are settled alone.
_KEPT = 64


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else the next free code point from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(free))
        free += b not in own
    return out


def _deltas(counts: list[int] | np.ndarray) -> bytes:
    return np.diff(counts, prepend=0).astype("<i2").tobytes()


class TokenPrefixes:
    """Exact token counts of every prefix under one tokenizer file (JSON, BPE with word ends)."""

    def __init__(self, path: str, cache: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not end:
            raise ValueError("a BPE with word ends is needed")
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        #: A merge must come after those that made its parts; then the last merge inside a token dates it.
        born = {a + b: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        if any(born.get(x, -1) >= i for i, ab in enumerate(pairs) for x in ab):
            raise ValueError("merges out of order")
        #: For each token that its own letters merge to: the two parts of its last merge (none for a letter).
        found = {t: p for t in model["vocab"] for p in [self._last_merge(t, end, rank)] if p is not None}
        number = {t: i for i, t in enumerate(found)}
        self.parts = [tuple(number[x] for x in p) for p in found.values()]
        self.rank = {(number[a], number[b]): r for (a, b), r in rank.items() if a in number and b in number}
        byte = {c: b for b, c in enumerate(_byte_letters())}
        self.tokens: list[tuple[bytes, bool]] = []
        for t in found:
            ends = t.endswith(end) and len(t) > len(end)
            self.tokens.append((bytes(byte[c] for c in (t[: -len(end)] if ends else t)), ends))
        self._suffix_tree()
        self.by_bytes = {t: i for i, t in enumerate(self.tokens)}
        self.longest = max(len(t) for t, _ in self.tokens)
        self._edges()
        self.pieces = Pieces(cache)
        self.pair_slots = 1 << 20  # a table of answers by the hash of a pair; a newer pair takes an older one's place
        self.pair_key, self.pair_ok = np.full(self.pair_slots, -1, np.int64), np.zeros(self.pair_slots, bool)

    @staticmethod
    def _last_merge(token: str, end: str, rank: dict) -> tuple[str, ...] | None:
        cut = len(end)
        symbols = [*token[: -cut - 1], token[-cut - 1 :]] if token.endswith(end) and len(token) > cut else list(token)
        last: tuple[str, ...] = ()
        while len(symbols) > 1:
            found = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(p)) is not None]
            if not found:
                return None
            i = min(found)[1]
            last = (symbols[i], symbols[i + 1])
            symbols[i : i + 2] = ["".join(last)]
        return last

    def _suffix_tree(self) -> None:
        """Tokens by their bytes from the last to the first: steps (node * 256 + byte) -> node. Roots: 0 inside words, 1 at their ends."""
        steps: dict[int, int] = {}
        token_at = [-1, -1]
        for i, (data, ends) in enumerate(self.tokens):
            at = int(ends)
            for b in reversed(data):
                new = steps.get(at * 256 + b)
                if new is None:
                    new = steps[at * 256 + b] = len(token_at)
                    token_at.append(-1)
                at = new
            token_at[at] = i
        keys = np.array(list(steps), np.int64)
        order = np.argsort(keys)
        self.step_keys, self.step_to = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.token_at = np.array(token_at, np.int64)

    def _edges(self) -> None:
        """For each token, the parts that touch its right and its left edge, smallest first, with the rank of the merge that
        takes each up; and all merges as sorted pairs with their ranks."""
        n = len(self.parts)
        self.edges = []
        for right in (1, 0):
            part, till, start = [], [], []
            for token in range(n):
                own, at = [(token, n)], token  # no rank reaches n
                while self.parts[at]:
                    own.append((self.parts[at][right], self.rank[self.parts[at]]))
                    at = own[-1][0]
                start.append(len(part))
                part += [x for x, _ in reversed(own)]
                till += [x for _, x in reversed(own)]
            self.edges.append(tuple(np.array(x, np.int64) for x in ([*start, len(part)], part, till)))
        keys = np.array([a * n + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the letters of a and b merge to just these two: no merge crosses the border before both sides have grown past it."""
        (start, x_part, x_till), (start_b, y_part, y_till) = self.edges
        n, ok = len(self.parts), np.ones(len(a), bool)
        i, j, left = start[a], start_b[b], np.arange(len(a))
        x_end, y_end = start[a + 1] - 1, start_b[b + 1] - 1
        while len(left):
            key = x_part[i] * n + y_part[j]
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            r = np.where(self.merge_keys[at] == key, self.merge_ranks[at], n)
            bad = (r < x_till[i]) & (r <= y_till[j])
            ok[left[bad]] = False
            on = ~bad & ((i < x_end) | (j < y_end))
            left, i, j, x_end, y_end = left[on], i[on], j[on], x_end[on], y_end[on]
            grow = x_till[i] <= y_till[j]
            i, j = i + grow, j + ~grow
        return ok

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_may_follow for many pairs; a of -1 is the start of a word, after which any token may stand."""
        key = a * len(self.tokens) + b
        slot = (key * np.int64(0x1E3779B97F4A7C15) >> np.int64(20)) & np.int64(self.pair_slots - 1)
        out = self.pair_ok[slot] | (a < 0)
        at = np.flatnonzero((self.pair_key[slot] != key) & (a >= 0))
        if len(at):
            _, first, back = np.unique(key[at], return_index=True, return_inverse=True)
            new = at[first]
            ok = self._may_follow(a[new], b[new])
            out[at] = ok[back]
            _, last = np.unique(slot[new], return_index=True)  # one pair for each slot
            self.pair_key[slot[new[last]]], self.pair_ok[slot[new[last]]] = key[new[last]], ok[last]
        return out

    def _last_tokens(self, root: int, node: np.ndarray, parent: np.ndarray, byte: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For prefixes (nodes of the tree of words): the last token of each one's encoding and the prefix before that token."""
        token, before = np.full(len(node), -1, np.int64), np.full(len(node), -1, np.int64)
        left, up, at = np.arange(len(node)), node, np.full(len(node), root, np.int64)
        while len(left):
            key = at * 256 + byte[up]
            i = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            on = self.step_keys[i] == key
            left, at, up = left[on], self.step_to[i[on]], parent[up[on]]
            t = self.token_at[at]
            some = np.flatnonzero(t >= 0)
            good = some[self._follow(last[up[some]], t[some])]
            token[left[good]], before[left[good]] = t[good], up[good]
            rest = up > 0
            rest[good] = False
            left, at, up = left[rest], at[rest], up[rest]
        return token, before

    def settle(self, words: list[str]) -> dict[str, bytes]:
        """The tables of different words of at most _KEPT code points: the change of the count at each, as 16-bit numbers."""
        words = sorted(words)  # by code point, which is the order of their bytes
        data = np.frombuffer("".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where code points begin
        own = np.array(list(map(len, words)), np.int64)
        size = np.diff(heads[np.append(0, np.cumsum(own))])
        width = int(size.max(initial=0))
        chars = np.full((len(words), width + 1), 256, np.int16)
        inside = np.arange(width + 1) < size[:, None]
        chars[inside] = data
        differ = np.ones((len(words), width + 1), bool)
        differ[1:] = np.logical_or.accumulate(chars[1:] != chars[:-1], axis=1)
        counts = np.zeros((len(words), width), np.int32)
        # Node 0 is the empty prefix; a node for each prefix that words share.
        parent, byte, last, count = [np.array([v]) for v in (-1, 0, -1, 0)]
        above = np.zeros(len(words), np.int64)
        for col in range(width):
            rows = np.flatnonzero(inside[:, col])
            new = differ[rows, col]
            first = rows[new]
            node = np.arange(len(parent), len(parent) + len(first))
            parent, byte = np.concatenate([parent, above[first]]), np.concatenate([byte, chars[first, col]])
            last = np.concatenate([last, np.zeros(len(first), np.int64)])
            token, before = self._last_tokens(0, node, parent, byte, last)
            ending, stem = self._last_tokens(1, node, parent, byte, last)
            if (token < 0).any():
                raise ValueError("a prefix without an encoding")
            last[node] = token
            count = np.concatenate([count, count[before] + 1])
            index = np.cumsum(new) - 1
            counts[rows, col] = np.where(ending >= 0, count[stem] + 1, 0)[index]
            above[rows] = node[index]
        stops = inside[:, :width] & ((chars[:, 1:] & 0xC0) != 0x80) if width else inside[:, :0]
        flat = counts[stops]
        starts = np.cumsum(own) - own
        if (flat < 1).any():
            raise ValueError("a word without an encoding")
        step = np.diff(flat, prepend=0)
        step[starts] = flat[starts]
        raw = step.astype("<i2").tobytes()
        return {w: raw[2 * s : 2 * (s + n)] for w, s, n in zip(words, starts.tolist(), own.tolist(), strict=True)}

    def _long_word(self, word: str) -> bytes:
        """The table of one word of any length: the same steps along the word, one at a time."""
        data, stops = b"", set()
        for c in word:
            data += c.encode("utf-8", "surrogatepass")
            stops.add(len(data))
        last, count, out, known, tokens = [-1], [0], [], {}, self.by_bytes

        def find(i: int, ends: bool, first: int) -> tuple[int, int]:
            for j in (max(0, first), *range(max(0, i - self.longest), i)):
                t = tokens.get((data[j:i], ends))
                if t is not None:
                    a = last[j]
                    ok = a < 0 or known.get((a, t))
                    if ok is None:
                        ok = known[a, t] = bool(self._may_follow(np.array([a]), np.array([t]))[0])
                    if ok:
                        return t, count[j] + 1
            raise ValueError(f"no token ends at {i}")

        for i in range(1, len(data) + 1):
            held = len(self.tokens[last[-1]][0]) if last[-1] >= 0 else 0
            t, n = find(i, False, i - 1 - held)  # most often the last token grows
            if i in stops:
                out.append(find(i, True, i - len(self.tokens[t][0]))[1])
            last.append(t)
            count.append(n)
        return _deltas(out)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Tables of unseen pieces: a word with the white space after it, which adds no token."""
        bare = {p: p.rstrip("\t\n\v\f\r \x85\xa0") for p in pieces}
        words = {w for w in bare.values() if w}
        found = self.settle([w for w in words if len(w) <= _KEPT])
        found.update((w, self._long_word(w)) for w in words if len(w) > _KEPT)
        return {p: (found[w] if w else b"") + bytes(2 * (len(p) - len(w))) for p, w in bare.items()}

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return _LATIN.findall(text.lower())
        except UnicodeEncodeError:
            norm = self.library.normalizer.normalize_str(text)
            pieces, at = [], 0
            for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm):
                pieces += [" "] * (a - at) + [norm[a:b]]
                at = b
            return pieces + [" "] * (len(norm) - at)

    @staticmethod
    def _in_parts(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART:
            m = _BREAK.search(text, at + PART)
            if not m:
                break
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    def _look_up(self, texts: list[str]) -> list[bytes]:
        """Tables of texts in which no special string is looked for."""
        get = self.pieces.__getitem__
        pieces = [self._split(t) for t in texts]
        found = [list(map(get, p)) for p in pieces]
        if self.pieces.missed:
            new = self._learn(list(set(self.pieces.missed)))
            self.pieces.learn(new)
            for p, f in zip(pieces, found, strict=True):
                i = -1
                for _ in range(f.count(None)):
                    i = f.index(None, i + 1)
                    f[i] = new[p[i]]
            for p in new:
                if len(p) > _KEPT:
                    del self.pieces[p]
        return [b"".join(f) for f in found]

    def _with_special(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.special.finditer(text):
            before, inside = self._look_up([text[at : m.start()], text[at : m.end() - 1]])  # until the string is whole, it is ordinary text
            total = int(np.frombuffer(before, "<i2").sum(dtype=np.int64)) + 1
            counts = np.cumsum(np.frombuffer(inside, "<i2"), dtype=np.int64)
            out.append(_deltas(np.append(counts, total)))
            at = m.end()
        return b"".join(out) + self._look_up([text[at:]])[0]

    def tables(self, texts: list[str | None]) -> list[bytes]:
        """For each text the change of the token count at each code point, as little-endian signed 16-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        rows, parts, held = [], [], 0

        def flush() -> None:
            for i, t in zip(rows, self._look_up(parts), strict=True):
                out[i].append(t)
            rows.clear(), parts.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text and self.special.search(text):
                out[i].append(self._with_special(text))
                continue
            for part in self._in_parts(text):
                rows.append(i), parts.append(part)
                held += len(part)
                if held >= PART:
                    flush()
                    held = 0
        flush()
        return [b"".join(x) if len(x) != 1 else x[0] for x in out]

    def counts(self, text: str | None) -> np.ndarray:
        """The exact number of tokens of every prefix of the normalised text, by code point."""
        return np.cumsum(np.frombuffer(self.tables([text])[0], "<i2"), dtype=np.int64)


_loaded: dict[str, TokenPrefixes] = {}


def loaded(path: str) -> TokenPrefixes:
    """One instance for each worker process."""
    if path not in _loaded:
        _loaded[path] = TokenPrefixes(path)
    return _loaded[path]


def fit(counts: np.ndarray, budget: int) -> int:
    """The length of the longest prefix of at most so many tokens, by look-up in the counts at all prefixes."""
    if not len(counts) or counts[-1] <= budget:
        return len(counts)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def token_prefixes(df: DataFrame, tokenizer: str, text: str = "text", budget: int = 2048, keep_prefixes: bool = True) -> DataFrame:
    """df without its text, with n_bytes, n_tokens, n_chars (of the normalised text), fit_chars (the longest prefix within
    budget tokens) and, unless switched off, prefix_steps: the change of the count at every code point (little-endian
    signed 16-bit numbers), whose running sum is the count at every prefix."""
    made = {"n_bytes": "long", "n_tokens": "long", "n_chars": "long", "fit_chars": "long"} | ({"prefix_steps": "binary"} if keep_prefixes else {})

    def start():
        prefixes = loaded(tokenizer)

        def some(texts: list[str | None]) -> list[tuple]:
            out = []
            for t, steps in zip(texts, prefixes.tables(texts), strict=True):
                counts = np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int32)
                size = len(t.encode("utf-8", "surrogatepass")) if t else 0
                row = (size, int(counts[-1]) if len(counts) else 0, len(counts), fit(counts, budget))
                out.append((*row, steps) if keep_prefixes else row)
            return out

        return some

    return per_value(df, text, made, start, together=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars and the table of all prefixes of every document under the word-end BPE."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = token_prefixes(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fit_chars", "prefix_steps")
