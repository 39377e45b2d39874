"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with itself, exact at any threshold.

A document's set is its distinct word n-grams (hashes of them). Documents with one set are one node. Two sets of S n-grams
together link when they differ in at most ``S * (100 - p) / (100 + p)`` n-grams, p being the least similarity in per cent.

Blocks. Nodes are filed by size in classes, and in the class above too if a partner may lie there. A class allows at most k
differing n-grams, and deals the n-grams by hash into m = k + t column blocks: two linked sets agree on t whole blocks at
least, as a differing n-gram spoils one block. So the digests of a node's blocks stand for the n-grams as columns of the
product, and pairs can only meet in a column that both have. Blocks of fewer than two n-grams are weak: they stay out, but
for a node with t or more of them, which keeps them all (two nodes that agree on weak blocks only have so many both).
Columns of one node are dropped. What remains counts towards t: a node with fewer takes no part, and of its columns, the
rarest first, all but the last t - 1 suffice. No column is cut, however common.

Product. Columns are multiplied in tiles of ``TILE`` nodes: overlaps accumulate from parities of n-gram counts in 8 k bits,
whose distance never exceeds the number of differing n-grams, so that pairs below the bound set by their sizes are
discarded without a miss. Of the survivors a tile hands on a spanning forest, closest first, to be verified in full, which
joins most copies. Then, of any two components that survivors still connect, the closest ``BATCH`` are verified, and
``GROWTH`` times as many in the next round, until all links between components are found. So copies cost a pair each, and
texts move only for pairs that are nearly certain to link.

Cases: null and blank texts have no set and link with nothing; shorter texts are one n-gram; rows alike share a node;
a null key takes no part in the smallest key; an empty table gives an empty table; further columns are not used. Sets
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, join_hot, materialise, per_value, table
from .graph import components
from .simhash import majority, signed

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TILE, BATCH, GROWTH = 1024, 64, 64
_U = np.uint64


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    """Another hash of each hash."""
    x = (x ^ (x >> _U(31))) * _U(by)
    return x ^ (x >> _U(29))


#: Odd factors from a fixed rule.
_A, _B, _C, _D, _E = (xxhash.xxh64_intdigest(f"factor {i}".encode()) | 1 for i in range(5))


def shingles(text: str | None, words_each: int) -> np.ndarray:
    """Sorted hashes of the different n-grams of words, from the words' hashes; of fewer words, one for the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # at space and 9 to 13
    n = len(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, n)
    each = min(words_each, n)
    if not each:
        return h
    made = h[: n - each + 1]
    for j in range(1, each):
        made = _mixed(made, _A) + h[j : n - each + 1 + j]
    return np.unique(_mixed(made, _B))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


class Deal:
    """How sets of each size are dealt into column blocks: the most n-grams of each class, and its k."""

    def __init__(self, percent: int, ratio: float = 1.5, bands: tuple[int, int] | None = None):
        """bands (number, depth): columns are bands of minima instead of blocks, fewer, but a link is missed now and then."""
        self.percent, self.ratio = percent, max(ratio, 100 / percent)  # so partners lie one class apart at most
        self.most: list[int] = [0]
        self.bands = bands
        if bands:
            self.flips, self.factors = (np.array([xxhash.xxh64_intdigest(f"{kind} {i}".encode()) | odd for i in range(bands[0] * bands[1])], _U) for kind, odd in (("flip", 0), ("factor", 1)))

    def _minima(self, own: np.ndarray) -> np.ndarray:
        """A digest of each band."""
        least = np.full(len(self.flips), np.iinfo(np.uint64).max, _U)
        for i in range(0, len(own), 512):
            least = np.minimum(least, ((own[i : i + 512, None] ^ self.flips) * self.factors).min(axis=0))
        made = np.arange(self.bands[0], dtype=_U)
        for each in least.reshape(self.bands).T:
            made = _mixed(made, _A) + each
        return _mixed(made, _B)

    def k(self, most: int) -> int:
        """How many n-grams of two linked sets of at most `most` each may differ."""
        return 2 * most * (100 - self.percent) // (100 + self.percent)

    def classes(self, n: int) -> list[int]:
        """The classes of a set of n, by their number."""
        while self.most[-1] < n * 100 // self.percent:
            self.most.append(max(self.most[-1] + 1, int(self.most[-1] * self.ratio)))
        c = int(np.searchsorted(self.most, n))
        return [x for x in ([c, c + 1] if n * 100 // self.percent > self.most[c] else [c]) if self.k(self.most[x])]

    def columns(self, own: np.ndarray, c: int, minima: np.ndarray | None = None) -> tuple[list[int], int, bytes]:
        """Digests of the set's blocks in class c, how many of these any linked set of the class has too, and its parities."""
        k = self.k(self.most[c])
        digests, need = self._blocks(own, c, k) if minima is None else (_mixed(minima + _U(c), _C), 1)
        bits = 64 * math.ceil(8 * k / 64)
        odd = np.bincount(((_mixed(own, _E) >> _U(11)) % _U(bits)).astype(np.int64), minlength=bits) & 1
        return digests.view(np.int64).tolist(), need, np.packbits(odd.astype(bool)).tobytes()

    def _blocks(self, own: np.ndarray, c: int, k: int) -> tuple[np.ndarray, int]:
        t = 1 + math.ceil(k / 4)
        m = k + t
        block = (_mixed(own, _C) >> _U(11)) % _U(m)
        order = np.argsort(block, kind="stable")
        block, held = block[order], _mixed(own, _D)[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        sizes = np.diff(np.r_[starts, len(own)])
        place = _mixed(block[starts] * _U(1 << 20) + _U(c), _E)
        digests = _mixed(np.add.reduceat(held, starts) ^ place, _C)
        weak = int(m - len(starts) + (sizes < 2).sum())
        if weak >= t:
            empty = np.setdiff1d(np.arange(m, dtype=_U), block[starts])
            digests, need = np.r_[digests, _mixed(empty * _U(1 << 20) + _U(c), _B)], 1
        else:
            digests, need = digests[sizes >= 2], t - weak
        return digests, need

    def sketch(self, own: np.ndarray) -> tuple:
        """node, n, the fingerprint, and columns, need, parities of the set's own class and of that above; None where there are none."""
        minima = self._minima(own) if self.bands and len(own) else None
        found = [self.columns(own, c, minima) for c in self.classes(len(own))] if len(own) else []
        node = int(np.int64(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64))) if len(own) else None
        return node, len(own), signed(majority(own)), *[x for own_class in [*found, *[([], None, None)] * 2][:2] for x in own_class]


_SKETCH = {"node": "long", "n": "long", "fp": "long", "columns0": "array<long>", "need0": "int", "parity0": "binary", "columns1": "array<long>", "need1": "int", "parity1": "binary"}


def _sketched(docs: DataFrame, key: str, text: str, words: int, percent: int, bands: tuple[int, int] | None) -> DataFrame:
    """key, at (two hashes of the text), node, n and columns; those of a set come once from each task that holds it."""

    def start():
        deal, seen = Deal(percent, bands=bands), set()

        def one(value: str | None) -> tuple:
            own = deal.sketch(shingles(value, words))
            if own[0] in seen:
                return *own[:3], [], None, None, [], None, None
            seen.add(own[0])
            return own

        return one

    held = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("at"), F.xxhash64(F.lit(1), text).alias("at2"), F.col(text).alias("text"))
    return materialise(per_value(held, "text", _SKETCH, start))


def _company(sketched: DataFrame) -> DataFrame:
    """column, node, upper, n, low: the nodes of each column that counts, their number and the least of them."""

    def filed(i: int) -> Column:
        return F.transform(f"columns{i}", lambda x: F.struct(x.alias("column"), F.lit(bool(i)).alias("upper"), F.col(f"need{i}").alias("need")))

    rows = sketched.select("node", F.explode(F.concat(filed(0), filed(1))).alias("x")).select("x.*", "node")
    by = Window.partitionBy("column")
    held = rows.repartition("column").groupBy("column", "node", "upper", "need").agg(F.lit(1).alias("_one")).withColumn("n", F.count(F.lit(1)).over(by)).filter("n > 1").drop("_one")
    held = materialise(held)
    own = Window.partitionBy("node", "upper")
    ranked = held.withColumn("have", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("n", "column")))
    kept = ranked.filter("rank <= have - need + 1").select("column", "node", "upper")
    out = materialise(kept.withColumn("n", F.count(F.lit(1)).over(by)).filter("n > 1").withColumn("low", F.min("node").over(by)))
    forget(held)
    return out


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, each: int = 64) -> DataFrame:
    """pairs (a, b; distinct) with ok. The text of a goes once to every `each` of its partners, whose texts follow it there."""
    partners = F.count(F.lit(1)).over(Window.partitionBy("a"))
    marked = materialise(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(partners / each)).cast("int")))
    first = marked.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rest = marked.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    dealt = first.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, _U)
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            found = []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if b is None:
                    own = shingles(text, words)
                else:
                    found.append((a, b, similar(own, shingles(text, words), percent)))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "ok"])

    out = materialise(dealt.mapInArrow(run, "a long, b long, ok boolean"))
    forget(marked)
    return out


class Rows:
    """Some rows of tiles, whole columns at a time: which may link, and what of that to hand on."""

    def __init__(self, parts: list[pa.RecordBatch], percent: int):
        one = pa.Table.from_batches(parts).combine_chunks()
        self.keys = np.stack([one.column(i).to_numpy() for i in range(4)])  # low, i, j, column
        self.tile, self.node, self.root, self.n = (one.column(i).to_numpy() for i in range(4, 8))
        self.starts = np.flatnonzero(np.r_[True, (self.keys[:, 1:] != self.keys[:, :-1]).any(axis=0)])
        self.ends = np.r_[self.starts[1:], len(self.node)]
        self.group = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        self.both = self.keys[1] != self.keys[2]
        self.percent = percent
        width = np.fromiter(map(len, parity := one.column(8).to_pylist()), np.int64, len(self.node))
        self.width, self.place, self.bits = width, np.zeros(len(width), np.int64), {}
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            self.place[own] = np.arange(len(own))
            self.bits[w] = np.frombuffer(b"".join([parity[i] for i in own.tolist()]), _U).reshape(len(own), -1)

    def _near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the pairs those that may link, with their distance: rows of group, distance, x, y."""
        tx, ty = self.tile[x], self.tile[y]
        keep = (self.root[x] != self.root[y]) & (~self.both[x] | (tx != ty))
        nx, ny = self.n[x], self.n[y]
        keep &= 100 * np.minimum(nx, ny) >= self.percent * np.maximum(nx, ny)
        x, y, out = x[keep], y[keep], []
        for w in np.unique(self.width[x]).tolist():
            own = self.width[x] == w
            u, v, bits = x[own], y[own], self.bits[w]
            apart, most = np.zeros(len(u), np.int64), (100 - self.percent) * (self.n[u] + self.n[v])
            for c in range(0, bits.shape[1], 16):  # by blocks of bits; a pair beyond its bound is out
                apart += np.bitwise_count(bits[self.place[u], c : c + 16] ^ bits[self.place[v], c : c + 16]).sum(axis=1, dtype=np.int64)
                near = apart * (100 + self.percent) <= most
                u, v, apart, most = u[near], v[near], apart[near], most[near]
            out.append(np.stack([self.group[u], apart, u, v]))
        return np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)

    def _chosen(self, rows: np.ndarray, batch: int) -> np.ndarray:
        """Which of the rows to hand on: of each two components of a group the closest `batch`; or, for 0, a spanning forest."""
        names, code = np.unique(np.stack([self.group, self.root]), axis=1, return_inverse=True)
        x, y = np.sort(np.stack([code[rows[2]], code[rows[3]]]), axis=0)
        order = np.lexsort((rows[3], rows[2], rows[1], y, x))
        if batch:
            x, y = x[order], y[order]
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
            rank = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
            return np.sort(order[rank < batch])
        label, taken, left = np.arange(names.shape[1]), [], np.argsort(rows[1], kind="stable")
        while len(left := left[label[x[left]] != label[y[left]]]):  # each component takes its closest edge
            ends = np.concatenate([label[x[left]], label[y[left]]])
            least = np.unique(np.unique(ends, return_index=True)[1] % len(left))
            picked = left[least]
            taken.append(picked)
            up: dict[int, int] = {}

            def top(c: int, up: dict = up) -> int:
                while (d := up.get(c, c)) != c:
                    up[c] = up.get(d, d)
                    c = d
                return c

            for u, v in zip(label[x[picked]].tolist(), label[y[picked]].tolist(), strict=True):
                p, q = top(u), top(v)
                if p != q:
                    up[max(p, q)] = min(p, q)
            label = np.fromiter(map(top, label.tolist()), np.int64, len(label))
        return np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)

    def pairs(self, batch: int, small: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """a, b, column and whether its group had more."""
        size, found = self.ends - self.starts, []
        at = np.flatnonzero((size <= small)[self.group])
        end = self.ends[self.group]
        d = 1
        while len(at := at[at + d < end[at]]):
            found.append(self._near(at, at + d))
            d += 1
        for g in np.flatnonzero(size > small).tolist():
            own = np.arange(self.starts[g], self.ends[g])
            rows = np.zeros((4, 0), np.int64)
            for i in range(0, len(own), 32):
                x = own[i : i + 32]
                u, v = np.nonzero(x[:, None] < own[None, :])
                rows = np.concatenate([rows, self._near(x[u], own[v])], axis=1)
                if rows.shape[1] > 200_000 and batch:
                    kept = self._chosen(rows, batch + 1)  # one more, so that there being more shows
                    rows = rows[:, kept]
            found.append(rows)
        rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        kept = self._chosen(rows, batch)
        had, left = (np.bincount(rows[0, k], minlength=len(size)) for k in (slice(None), kept))
        rows = rows[:, kept]
        a, b = np.sort(np.stack([self.node[rows[2]], self.node[rows[3]]]), axis=0)
        return a, b, self.keys[3][rows[2]], (had > left)[rows[0]]


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 8192) -> Iterator[list[pa.RecordBatch]]:
    """Batches cut where the column (the fourth key) changes, some `size` rows together, or one column alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        told = np.stack([batch.column(i).to_numpy() for i in range(4)])
        cuts = np.r_[0, np.flatnonzero((told[:, 1:] != told[:, :-1]).any(axis=0)) + 1]
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(4)) and sum(h.num_rows for h in held) >= size:
            yield held
            held = []
        at = 0
        for cut in [*cuts[1:].tolist()]:
            if sum(h.num_rows for h in held) + cut - at >= size:
                yield [*held, batch.slice(at, cut - at)]
                held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield held


def _unjoined(members: DataFrame, sketches: DataFrame, roots: DataFrame | None, percent: int, batch: int) -> DataFrame:
    """a, b, column, more: what tiles of columns with several components leave to verify. Tiles with one least node, which
    copies share over many columns, follow each other in a task, which hands a pair on once for them."""
    rooted = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by = Window.partitionBy("column")
    mixed = rooted.withColumn("_least", F.min("root").over(by)).withColumn("_most", F.max("root").over(by)).filter("_least <> _most")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    placed = mixed.withColumn("_own", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    placed = placed.select("low", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "column", (F.col("_own") > F.col("_other")).cast("int").alias("tile"), "node", "root", "upper")
    order = ["low", "i", "j", "column"]
    dealt = placed.join(sketches, ["node", "upper"]).select(*order, "tile", "node", "root", "n", "parity").repartition("low", "i", "j").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_of, seen = None, set()
        for parts in _chunks(batches):
            rows = Rows(parts, percent)
            a, b, column, more = rows.pairs(batch)
            low = tuple(rows.keys[:3, 0].tolist())
            if low != run_of or len(seen) > 1_000_000:
                run_of, seen = low, set()
            keep, told = [], set()
            for i, pair in enumerate(zip(a.tolist(), b.tolist(), column.tolist(), strict=True)):
                if pair[:2] not in seen or pair[2] not in told:  # a column with survivors shows in one row at least
                    keep.append(i)
                    seen.add(pair[:2])
                told.add(pair[2])
            run_of = tuple(rows.keys[:3, -1].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, column, more)], names=["a", "b", "column", "more"])

    return dealt.mapInArrow(run, "a long, b long, column long, more boolean")


def links(docs: DataFrame, key: str, text: str, words: int, percent: int, hints=None, bands: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, n; n-grams of the row's set) and roots (node, root) of all nodes that link with another.

    hints(sketched rows) may give further pairs (a < b) of nodes to verify first. bands: see Deal.
    """
    sketched = _sketched(docs, key, text, words, percent, bands)
    rows = materialise(sketched.select("key", "node", "n", "fp", "at", "at2"))
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("at", "at2")).alias("one")).select("node", "one.*")
    members = _company(sketched)
    parity = [F.struct(F.lit(bool(i)).alias("upper"), F.col(f"parity{i}").alias("parity")) for i in range(2)]
    each = sketched.select("node", "n", F.explode(F.array(*parity)).alias("x")).select("node", "n", "x.*").filter("parity IS NOT NULL")
    sketches = materialise(each.join(members.select("node", "upper").distinct(), ["node", "upper"], "left_semi").dropDuplicates(["node", "upper"]))
    found = materialise(_unjoined(members, sketches, None, percent, 0))
    forget(sketched)
    columns = found.select("column").distinct()  # no other has two nodes that may link
    members = materialise(members.join(columns, "column", "left_semi"))
    pairs = materialise((found.select("a", "b") if hints is None else found.select("a", "b").union(hints(rows))).distinct())
    ends = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = materialise(_texts(docs, text, ends.join(nodes, "node")))
    tested, batch = verified(pairs, texts, words, percent), BATCH
    while True:
        linked = tested.filter("ok").select("a", "b")
        roots = materialise(components(linked, 2))  # rough ones: two nodes that they tell apart are only looked at once more
        found = materialise(_unjoined(members, sketches, roots, percent, batch))
        new = materialise(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        more = found.filter("more").limit(1).count()
        if new.limit(1).count():
            tested = materialise(tested.unionByName(verified(new, texts, words, percent)))
        for held in (new, found, roots):
            forget(held)
        if not more:  # all that the tiles found is tested
            return rows, materialise(components(tested.filter("ok").select("a", "b")))
        batch *= GROWTH


#: Bytes of the texts' places that are sent to all tasks; a table of more is joined by a shuffle.
SENT = 64 << 20


def _texts(docs: DataFrame, text: str, wanted: DataFrame, salts: int = 16) -> DataFrame:
    """node, text for wanted (node, at, at2): few enough of them are sent to the texts; else rows are salted by their place, so
    that copies of a text spread, and one leaves each task."""
    wanted = materialise(wanted)
    held = docs.select(F.xxhash64(text).alias("at"), F.xxhash64(F.lit(1), text).alias("at2"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("salt"), F.col(text).alias("text"))
    if wanted.count() * 32 <= SENT:
        met = held.join(F.broadcast(wanted), ["at", "at2"])
    else:
        spread = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
        met = held.join(spread, ["at", "at2", "salt"])
    return met.groupBy("node").agg(F.first("text").alias("text"))


def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """key, n and component: the smallest key of all that links join, null where none has one."""
    low = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("low"))
    rooted = materialise(low.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = rooted.groupBy("root").agg(F.min("low").alias("component"))
    labels = join_hot(rooted.select("node", "root"), least, ["root"], ["node"]).select("node", "component")
    joined = join_hot(rows.filter("node IS NOT NULL"), labels, ["node"], ["key"]).select("key", "n", "component")
    return joined.unionByName(rows.filter("node IS NULL").select("key", "n", F.col("key").alias("component")))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id."""
    out = labelled(*links(docs, key, text, words, percent))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))
