"""Catalogue questions: counts, groups, pages, latest state, validation, deletes, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import join_hot


def count_by(df: DataFrame, by: str, name: str = "count") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def topic_count(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    return found.agg(F.countDistinct(doc).alias("documents"), F.count(F.lit(1)).alias("passages"))


def topic_by(found: DataFrame, by: str) -> DataFrame:
    """Passages by a column, null and blank as Unknown, with position: most first, ties by first rank and name. One row a value."""
    g = F.coalesce(F.when(F.col(by) != "", F.col(by)), F.lit("Unknown"))
    groups = found.groupBy(g.alias(by)).agg(F.count(F.lit(1)).alias("passages"), F.min("rank").alias("first_rank"))
    order = Window.orderBy(F.desc("passages"), "first_rank", by)  # over groups, not rows
    return groups.withColumn("position", F.row_number().over(order)).orderBy("position")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page, with total and total_pages on each row. The total is a count of its own, not a window over all rows."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages start at 1 and hold 1 to 100 rows")
    total = df.count()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total", F.lit(total).cast("long")).withColumn("total_pages", F.lit(max(1, -(-total // size))).cast("long"))


def latest(df: DataFrame, by: str, *order: str) -> DataFrame:
    """The last row of each group, by max of a struct: partial before the shuffle, so a group with many rows is no hot spot."""
    rest = [c for c in df.columns if c not in (by, *order)]
    return df.groupBy(by).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(by, "_r.*")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """text, n for texts that occur more than once: counted by digest, with a place to fetch each text from, so that only
    repeated texts move, once for each task that holds them."""
    digest = F.xxhash64(text), F.md5(text)
    often = df.filter(F.col(text).isNotNull()).groupBy(*(d.alias(n) for d, n in zip(digest, ("_h", "_m"), strict=True))).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = df.select(text, digest[0].alias("_h"), digest[1].alias("_m")).join(often, ["_h", "_m"], "left_semi")
    return held.groupBy("_h", "_m").agg(F.first(text).alias(text)).join(often, ["_h", "_m"]).select(text, "n")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter((F.col(column) < low) | (F.col(column) > high))


def violations(df: DataFrame, bounds: dict[str, tuple[float, float]], allowed: dict[str, tuple] | None = None) -> DataFrame:
    """df with `violations`: the names of the columns that are null, outside their bounds or not among the values allowed."""
    bad = [F.when(F.coalesce(F.col(c).between(low, high), F.lit(False)), None).otherwise(c) for c, (low, high) in bounds.items()]
    bad += [F.when(F.coalesce(F.col(c).isin(*vs), F.lit(False)), None).otherwise(c) for c, vs in (allowed or {}).items()]
    return df.withColumn("violations", F.array_compact(F.array(*bad)))


def means(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the mean of each metric, null where there is none."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def retry_failed(docs: DataFrame, status: str = "status") -> DataFrame:
    return docs.withColumn(status, F.when(F.col(status) == "failed", "pending").otherwise(F.col(status)))


def histogram(df: DataFrame, value: str, bounds: list[float], by: str | None = None) -> DataFrame:
    """Cumulative counts: le and the number of values up to it, with +Inf; one pass, one row of counters a task."""
    names = [f"_{i}" for i in range(len(bounds) + 1)]
    v = F.col(value)
    counts = [F.count_if(v <= F.lit(b)).alias(n) for b, n in zip(bounds, names, strict=False)] + [F.count(v).alias(names[-1])]
    g = df.groupBy(by) if by else df.groupBy()
    les = [str(float(b)) for b in bounds] + ["+Inf"]
    pairs = F.explode(F.array(*[F.struct(F.lit(le).alias("le"), F.col(n).alias("n")) for le, n in zip(les, names, strict=True)])).alias("p")
    return g.agg(*counts).select(*([by] if by else []), pairs).select(*([by] if by else []), "p.le", "p.n")


def cache_split(texts: DataFrame, cache: DataFrame, text: str = "text", now: Column | None = None, ttl_seconds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose md5 the cache has, with its vector, and the distinct texts that it lacks.

    With ttl_seconds, entries that were cached (column cached_at) so long before `now` or longer are as good as absent.
    """
    if ttl_seconds is not None:
        age = F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros("cached_at")
        cache = cache.filter(age < F.lit(ttl_seconds * 1_000_000)).drop("cached_at")
    keyed = texts.withColumn("key", F.md5(text))
    lacking = keyed.select("key", text).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    return join_hot(keyed, cache, ["key"]), lacking
