"""Exact removal of repeated byte strings, by interleave refinement of shard Burrows-Wheeler columns.

Every ``length``-byte window of a text is filed under one anchor: the gram of ``gram`` bytes in it with the smallest hash
(the last such). Equal windows have equal anchors at equal places, so each anchor's windows can be settled by themselves,
wherever they come from; windows next to each other with the same anchor form one run, and the runs of a text do not
overlap. A run is settled without its bytes where its anchor occurs nowhere else (nothing repeats) or where the same run
occurs again (all of it repeats). Only anchors with different runs need bytes, once for each different run.

These runs, the shards, are lined up at their anchor and merged column by column from the right: the character before
the current column is the Burrows-Wheeler column of each shard, and a stable partition of the interleave by it is the
order of all suffixes that start one column further left. Common prefixes follow from those of the step before (one more
than the smallest in between if the characters agree, else none); no suffix is sorted again. Where a common prefix
reaches ``length``, the suffixes form a repeated interval, and the windows that start there repeat.

Scale: runs carry two hashes and a place, about one for each 65 bytes of text; counts are partial before the shuffle.
Runs whose anchor occurs once leave after one count of anchors, so that later shuffles carry repeated text only. Joins go by
anchor and salt; the other side is repeated for just the salts that occur, so it never outgrows the runs. One copy of a
text gives its bytes to the merge, and copies meet the text's decisions by salt again.
An anchor with more than ``most_shards`` different runs is not merged in one task: its windows are counted by digest
instead, which gives the same answer. Texts are named by hash and size, so copies share their decisions.

Cases: null text is empty; texts shorter than ``length`` keep all; copies of a text of at least ``length`` bytes lose all
their bytes; null and repeated ids are harmless; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, free_name, join_hot, materialise, per_value, quoted, salt_bits, salts_of, table

_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def anchored_runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, anchor place, first window and number of windows of each run."""
    n, width = len(data), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    x += np.uint64(1)
    x *= _powers_of(_BASE, n)
    np.cumsum(x, out=x)
    h = x[gram - 1 :].copy()
    h[1:] -= x[: n - gram]
    m = len(h)
    h *= _powers_of(pow(_BASE, -1, 1 << 64), m)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    key = np.full(-(-m // width) * width, 2**64 - 1, np.uint64)
    key[:m] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(0xFFFFFFFF, 0xFFFFFFFF - m, -1, dtype=np.uint64)
    blocks = key.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).reshape(-1)  # minimum from each block's start, and to its end
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = m - width + 1
    least = np.minimum(down[:windows], up[width - 1 : width - 1 + windows])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    place = (np.uint64(0xFFFFFFFF) - (least[first] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return h[place].view(np.int64), place, first, np.diff(np.r_[first, windows])


def text_name(data: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(data, 7)).astype(np.int64))


def runs_of(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """A row for each run of each text: who (from docs), anchor, run (its identity), name and n_bytes of the text, first, windows, offset."""
    made = {"anchor": "long", "run": "long", "name": "long", "n_bytes": "int", "first": "int", "windows": "int", "offset": "int"}
    h64 = xxhash.xxh3_64_intdigest

    def one(t: str | None) -> list[tuple]:
        data = (t or "").encode("utf-8", "surrogatepass")
        a, p, f, w = anchored_runs(data, length, gram)
        if not len(a):
            return []
        name, n = text_name(data), len(data)
        o = p - f
        ids = np.array([h64(data[i : i + k + length - 1], (k << 16) | j) for i, k, j in zip(f.tolist(), w.tolist(), o.tolist(), strict=True)], np.uint64).view(np.int64)
        return [(x, y, name, n, i, k, j) for x, y, i, k, j in zip(a.tolist(), ids.tolist(), f.tolist(), w.tolist(), o.tolist(), strict=True)]

    return per_value(docs.select(text, "who"), text, made, lambda: one, many=True)


def _intervals(flags: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return edge.tolist()


def merge_shards(anchor: np.ndarray, spans: list[bytes], windows: np.ndarray, offset: np.ndarray, length: int, gram: int) -> list[list[int]]:
    """For each shard (sorted by anchor) the windows that another shard of its anchor has too, as [start, end, ...)."""
    n, left = len(spans), length - gram
    width = left + length
    size = np.array([len(s) for s in spans])
    chars = np.full((n, width), 256, np.uint16)
    rows = np.repeat(np.arange(n), size)
    cols = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left - offset, size)
    chars[rows, cols] = np.frombuffer(b"".join(spans), np.uint8)
    chars = np.ascontiguousarray(chars.T)
    group = np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]]) * 257
    order, prefix = np.arange(n), np.zeros(n + 1, np.int32)  # prefix[i]: what the suffixes at i - 1 and i have in common
    found = np.zeros((width, n), bool)
    for col in range(width - 1, -1, -1):
        now = chars[col][order]
        key = group + now
        real = now < 256
        if (key[1:] >= key[:-1]).all():
            same = (key[1:] == key[:-1]) & real[1:]
            prefix[1:n] = np.where(same, prefix[1:n] + 1, 0)
        else:
            step = np.argsort(key, kind="stable")
            key = key[step]
            same = (key[1:] == key[:-1]) & real[step][1:]
            a, b = step[:-1] + 1, step[1:] + 1
            at = np.flatnonzero(same)
            low = np.zeros(n - 1, np.int32)
            if len(at):
                low[at] = np.minimum.reduceat(prefix, np.stack([a[at], b[at]], axis=1).ravel())[::2] + 1
            prefix[1:n] = low
            order = order[step]
        long_ = prefix >= length
        found[col, order] = long_[:-1] | long_[1:]
    out = []
    for i in range(n):
        s = left - int(offset[i])
        out.append(_intervals(found[s : s + int(windows[i]), i]))
    return out


def _decide(spans: DataFrame, length: int, gram: int, batch_rows: int = 20_000) -> DataFrame:
    """spans (anchor, run, windows, offset, span) -> anchor, run, repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(t: pa.Table) -> pa.RecordBatch:
            anchor = t["anchor"].to_numpy()
            found = merge_shards(anchor, t["span"].to_pylist(), t["windows"].to_numpy(), t["offset"].to_numpy(), length, gram)
            some = [i for i, x in enumerate(found) if x]
            at = pa.array(some, pa.int64())
            keys = [t[c].combine_chunks().take(at) for c in ("anchor", "run")]
            return pa.RecordBatch.from_arrays([*keys, pa.array([found[i] for i in some], pa.list_(pa.int64()))], names=["anchor", "run", "repeats"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= batch_rows:
                t = pa.Table.from_batches(held)
                a = t["anchor"].to_numpy()
                cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
                if cut:
                    for s, e in _pieces(a[:cut], batch_rows):
                        yield settle(t.slice(s, e - s))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if rows:
            t = pa.Table.from_batches(held)
            for s, e in _pieces(t["anchor"].to_numpy(), batch_rows):
                yield settle(t.slice(s, e - s))

    dealt = spans.select("anchor", "run", "windows", "offset", "span").repartition("anchor").sortWithinPartitions("anchor", "run")
    return dealt.mapInArrow(run, "anchor long, run long, repeats array<long>")


def _pieces(anchor: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """Cuts between anchors, at least rows apart."""
    out, s = [], 0
    while s < len(anchor):
        e = len(anchor) if s + rows >= len(anchor) else int(np.searchsorted(anchor, anchor[s + rows - 1], "right"))
        out.append((s, e))
        s = e
    return out


def _count_windows(spans: DataFrame, length: int) -> DataFrame:
    """The same answer as _decide, by counting digests of windows: for anchors with too many different runs for a task."""

    def one(v: dict) -> list[tuple]:
        s, o = v["span"], v["offset"]
        return [(xxhash.xxh3_128_digest(s[j : j + length], o - j), j) for j in range(v["windows"])]

    rows = per_value(spans.select("anchor", "run", F.struct("span", "offset", "windows").alias("v")), "v", {"digest": "binary", "at": "long"}, lambda: one, many=True)
    twice = rows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "digest")
    at = rows.join(twice, ["anchor", "digest"], "left_semi").groupBy("anchor", "run").agg(F.sort_array(F.collect_set("at")).alias("at"))
    return at.select("anchor", "run", F.flatten(F.transform("at", lambda x: F.array(x, x + 1))).alias("repeats"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, gram: int = 64, most_shards: int = 50_000, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) unless keep_text is false."""
    rest = [c for c in docs.columns if c != text and c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    # A row's salt comes from its other columns: copies of a text spread, and a lost task's rows come back alike.
    who = (F.xxhash64(*map(quoted, rest)) if rest else F.lit(0)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    salt = F.pmod(F.col("who"), F.lit(64)).cast("int")
    told = docs.select(F.col(text).alias("text"), who.alias("who"))
    runs = materialise(runs_of(told, "text", length, gram).withColumn("salt", salt))
    alone = F.count(F.lit(1)) == 1
    often = runs.groupBy("anchor").agg(alone.alias("alone"), (F.min("run") != F.max("run")).alias("mixed"), salt_bits(F.col("salt")).alias("salts"))
    often = often.filter("NOT alone").select("anchor", "mixed", salts_of(F.col("salts"), 64).alias("salt"))
    live = materialise(runs.join(often, ["anchor", "salt"]))  # what occurs once under its anchor goes no further
    forget(runs)
    whole = F.struct("name", "n_bytes", "first", "windows", "offset", "who")
    same = materialise(live.groupBy("anchor", "run", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("at"), salt_bits(F.col("salt")).alias("salts")))
    mixed = same.filter("mixed").select("anchor", "run", "n", "at")
    shards = join_hot(mixed, mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("shards")), ["anchor"], ["run"]).select("anchor", "run", "n", "shards", "at.*")
    # Of the copies of a text only the one that all its runs name gives its bytes.
    wanted = shards.groupBy("name", "n_bytes", "who").agg(F.collect_list(F.struct("anchor", "run", "shards", "first", "windows", "offset")).alias("cuts"))

    def named(t: str | None) -> tuple[int, int, bytes]:
        data = (t or "").encode("utf-8", "surrogatepass")
        return text_name(data), len(data), data

    def cut(v: dict) -> list[tuple]:
        return [(c["anchor"], c["run"], c["shards"], c["windows"], c["offset"], v["data"][c["first"] : c["first"] + c["windows"] + length - 1]) for c in v["cuts"]]

    texts = per_value(told, "text", {"name": "long", "n_bytes": "int", "data": "binary"}, lambda: named)
    held = texts.join(wanted, ["name", "n_bytes", "who"]).select(F.struct("data", "cuts").alias("v"))
    spans = per_value(held, "v", {"anchor": "long", "run": "long", "shards": "long", "windows": "int", "offset": "int", "span": "binary"}, lambda: cut, many=True).dropDuplicates(["anchor", "run"])
    spans = materialise(spans)
    by_merge = _decide(spans.filter(F.col("shards") <= most_shards), length, gram)
    decided = materialise(by_merge.unionByName(_count_windows(spans.filter(F.col("shards") > most_shards), length)))
    forget(spans)
    each = salts_of(F.col("salts"), 64).alias("salt")
    again = same.filter("n > 1").select("anchor", "run", F.array(F.lit(0), F.col("at.windows").cast("long")).alias("repeats"), each)
    once = decided.join(same.filter("n = 1"), ["anchor", "run"]).select("anchor", "run", "repeats", each)
    places = F.transform("repeats", lambda x, i: x + F.col("first") + F.when(i % 2 == 1, length - 1).otherwise(0))
    hits = live.join(again.unionByName(once), ["anchor", "run", "salt"]).groupBy("name", "n_bytes", "first").agg(F.first(places).alias("places"), salt_bits(F.col("salt")).alias("salts"))
    by_text = hits.groupBy("name", "n_bytes").agg(F.flatten(F.collect_list("places")).alias("places"), F.bit_or("salts").alias("salts"))
    names = free_name(docs, "name", "size", "data", "salt", "places", "value")
    name, size, data, own_salt, own_places, value = names
    all_texts = per_value(docs.select(text, *map(quoted, rest), F.pmod(who, F.lit(64)).cast("int").alias(own_salt)), text, {name: "long", size: "int", data: "binary"}, lambda: named)
    cuts = by_text.select(F.col("name").alias(name), F.col("n_bytes").alias(size), F.col("places").alias(own_places), salts_of(F.col("salts"), 64).alias(own_salt))
    joined = all_texts.join(cuts, [name, size, own_salt], "left").select(*map(quoted, rest), F.struct(F.col(data).alias("data"), F.col(own_places).alias("places")).alias(value))

    def finish(v: dict) -> tuple:
        data, places = v["data"], v["places"]
        kept, removed, spans_, at = [], 0, 0, 0
        if places:
            cuts = np.array(places, np.int64).reshape(-1, 2)
            cuts = cuts[np.argsort(cuts[:, 0], kind="stable")]
            ends = np.maximum.accumulate(cuts[:, 1])
            new = np.flatnonzero(np.r_[True, cuts[1:, 0] > ends[:-1]])
            for s, e in zip(cuts[new, 0].tolist(), ends[np.r_[new[1:] - 1, len(cuts) - 1]].tolist(), strict=True):
                kept.append(data[at:s])
                removed, spans_, at = removed + e - s, spans_ + 1, e
        kept.append(data[at:])
        out = b"".join(kept)
        return (len(data), removed, spans_, hashlib.sha256(out).hexdigest(), *([out] if keep_text else []))

    made = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"kept": "binary"} if keep_text else {})
    return per_value(joined, value, made, lambda: finish)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)
