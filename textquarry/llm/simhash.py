"""SimHash near-dedup with pivot distance tables.

Each text gets a 64-bit fingerprint. Documents with equal fingerprints form a class, so that copies weigh nothing from
there on. Any two fingerprints at most two bits apart agree on two of their four 16-bit quarters at least: the six pairs
of quarters deal the classes out. Within a deal, each fingerprint's Hamming distances to ``PIVOTS`` are tabled once; as
distances obey the triangle inequality, a pair whose distances to any pivot differ by more than two is discarded without
looking at it, and the survivors are verified bit by bit. A deal with many fingerprints is dealt again by pairs of quarters
of the bits that still differ, as often as needed: each time half of these bits are left, so that no pair is lost and no
deal of more than a few thousand is compared in full. Each batch passes on only a spanning forest
of its links, whose components are found by star steps.

Cases: null and blank texts have fingerprint zero and are linked like any other; ties and repeated rows share a class;
a null id takes no part in the smallest id (a component of null ids only has id null); an empty table gives an empty
table; further columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialise, per_value, table
from .graph import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Reference fingerprints: from a fixed rule, so that every task has the same.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode()) for i in range(24)], np.uint64)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The number whose bits are those that over half of the hashes have."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i : i + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # at space and 9 to 13
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        hashes = [h(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        hashes = [h(joined[a:b], seed) for a, b in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=False)]
    return majority(hashes)


def signed(fp: int) -> int:
    """An unsigned 64-bit number as Spark holds it."""
    return int(np.uint64(fp).astype(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 3, seed: int = 42) -> DataFrame:
    """key and fp, the fingerprint as a signed 64-bit number."""

    def one(t: str | None) -> tuple:
        return (signed(fingerprint(t, words_each, seed)),)

    return per_value(docs.select(key, text), text, {"fp": "long"}, lambda: one)


def _close(key: np.ndarray, fp: np.ndarray, most: int, limit: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with equal key and fingerprints at most so many bits apart; key is sorted."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for s, n in zip(starts[sizes > limit].tolist(), sizes[sizes > limit].tolist(), strict=True):
        own = fp[s : s + n]
        free = [b for b in range(64) if int(np.bitwise_or.reduce(own ^ own[0])) >> b & 1]
        if len(free) < 2 * (most + 2):  # these bits tell few fingerprints apart
            for a, b in _close(np.zeros(n, np.int64), own, most, n):
                yield s + a, s + b
            continue
        # Of most + 2 parts of the free bits, two fingerprints so close agree on two: a deal by each pair of parts.
        parts = [sum(((own >> np.uint64(b) & np.uint64(1)) << np.uint64(j) for j, b in enumerate(p)), np.zeros(n, np.uint64)) for p in np.array_split(free, most + 2)]
        width = np.uint64(max(len(p) for p in np.array_split(free, most + 2)))
        for x, y in combinations(parts, 2):
            k = x << width | y
            order = np.argsort(k, kind="stable")
            for a, b in _close(k[order], own[order], most, limit):
                yield s + order[a], s + order[b]
    small = np.repeat(sizes <= limit, sizes)
    at = np.flatnonzero(small)
    near = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)  # the distance table
    j = 1
    while len(at := at[at + j < len(key)]) and len(at := at[key[at] == key[at + j]]):
        far = np.zeros(len(at), bool)
        for p in range(len(PIVOTS)):
            far |= np.abs(near[at, p] - near[at + j, p]) > most
            if p % 8 == 7 and far.all():
                break
        kept = at[~far]
        kept = kept[np.bitwise_count(fp[kept] ^ fp[kept + j]) <= most]
        if len(kept):
            yield kept, kept + j
        j += 1


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def close_pairs(classes: DataFrame, most: int = 2, batch_rows: int = 200_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most two bits apart: in each deal, a spanning forest of them."""
    if most > 2:
        raise ValueError("four quarters find two bits at most")
    quarters = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(quarters[i], 16) + quarters[j] for n, (i, j) in enumerate(combinations(range(4), 2))]
    dealt = classes.select("fp", F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key")

    def links(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        found = np.array(_forest(_close(key, fp.view(np.uint64), most)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[found[:, 0]], "b": fp[found[:, 1]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch["key"].to_numpy(), batch["fp"].to_numpy()]))
            if sum(x.shape[1] for x in held) >= batch_rows:
                key, fp = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield links(key[:cut], fp[:cut].copy())
                held = [np.stack([key[cut:], fp[cut:]])]
        if held:
            key, fp = np.concatenate(held, axis=1)
            yield links(key, fp.copy())

    return dealt.mapInPandas(run, "a long, b long")


def simhash_components(fps: DataFrame, key: str = "doc_id", most: int = 2) -> DataFrame:
    """fps (key, fp; materialised) with component_id, the smallest key that can be reached over links."""
    classes = materialise(fps.groupBy("fp").agg(F.min(key).alias("low")))
    found = components(close_pairs(classes.select("fp"), most))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = join_hot(rooted.select("fp", "root"), low, ["root"], ["fp"]).select("fp", "component_id")
    return join_hot(fps, labels, ["fp"], [key]).select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 3, most: int = 2) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id."""
    out = simhash_components(materialise(fingerprints(docs, key, text, words_each)), key, most)
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
