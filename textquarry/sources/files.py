"""Files in, tables out: dispatch by suffix, tolerant decoding, keyed upserts and deletes on Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import markup

#: Which reader a suffix gets (fixed values).
PARSERS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "html": "html", "htm": "html", "xhtml": "html", "txt": "text", "log": "text", "md": "markdown", "mdx": "markdown", "markdown": "markdown"}
UPLOADS = ("pdf", "docx", "txt", "md", "html")
MAX_BYTES = 50 * 1024 * 1024


def dispatched(files: DataFrame) -> DataFrame:
    """files with suffix (lower case) and parser (null: no parser for it) by path."""
    parser = F.try_element_at(F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv]), F.col("suffix"))
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).withColumn("parser", parser)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, parser, content, length, text (see encoding; null for binary formats)."""
    raw = spark.read.format("binaryFile").load(path)
    text = decoded("content")
    named = dispatched(raw.select("path", "content", "length")).select("path", "suffix", "content", "length", "parser")
    return named.withColumn("text", F.when(F.col("parser").isin("text", "markdown", "html"), text))


def admitted(files: DataFrame) -> DataFrame:
    return files.withColumn("admitted", F.col("suffix").isin(*UPLOADS) & (F.col("length") <= MAX_BYTES))


def text_documents(files: DataFrame) -> DataFrame:
    """path, title (the stem, in title case), raw_text, word_count of plain-text and Markdown files."""
    clean = T.clean_text("text")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.filter(F.col("parser").isin("text", "markdown")).select("path", F.initcap(F.translate(stem, "_-", "  ")).alias("title"), clean.alias("raw_text"), T.word_count(clean).alias("word_count"))


def parse_files(files: DataFrame) -> DataFrame:
    """Sections of all files that have a reader (word-processor files where `content` is given), and a row with an error for each other file.

    path, section_no, heading, level, text, has_table, error. A file that cannot be read is data, not an end of the job.
    """
    own = {"html": markup.html_sections, "markdown": markup.markdown_sections, "text": markup.text_sections}
    parts = [read(files.filter(F.col("parser") == kind), "path", "text").withColumn("error", F.lit(None).cast("string")) for kind, read in own.items()]
    errors = []
    if "content" in files.columns:
        sections, bad = markup.docx_sections(files.filter("parser = 'docx'"))
        parts.append(sections.withColumn("error", F.lit(None).cast("string")))
        errors.append(bad)
        own["docx"] = None
    why = F.when(F.col("parser").isNull(), F.concat(F.lit("no parser for ."), F.col("suffix"))).otherwise(F.concat(F.lit("no text in ."), F.col("suffix")))
    other = files.filter(F.col("parser").isNull() | ~F.col("parser").isin(*own)).select("path", why.alias("error"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, other, *errors])


def index_records(docs: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text", most: int = 50_000) -> DataFrame:
    """The catalogue row of each document: status (indexed where it has chunks), chunk_count, the start of its text."""
    n = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"))
    count = F.coalesce("chunk_count", F.lit(0))
    return docs.join(n, key, "left").select(key, F.when(count > 0, "indexed").otherwise("failed").alias("status"), count.alias("chunk_count"), F.substring(text, 1, most).alias("raw_text"))


def tags(c) -> Column:
    return F.filter(F.transform(F.split(c, ","), T.strip), lambda x: x != "")


QUESTION = "question string, ground_truth string, answer string, contexts array<string>"


def parse_questions(lines: DataFrame, line: str = "value") -> DataFrame:
    """Evaluation questions of JSON lines; blank lines are skipped."""
    held = lines.filter(T.strip(line) != "").select(F.from_json(line, QUESTION).alias("_q")).select("_q.*")
    return held.withColumn("ground_truth", F.coalesce("ground_truth", F.lit("")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines file of evaluation questions; blank lines are skipped."""
    return parse_questions(spark.read.text(path))


#: Byte order marks and the encodings they tell (fixed values), longest first.
MARKS = (("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))


def encoding(content) -> Column:
    """UTF-8 or UTF-16 by their marks, else UTF-8 where the bytes are valid, else Latin-1."""
    c = F.col(content) if isinstance(content, str) else content
    marked = reduce(lambda rest, m: F.when(F.startswith(F.hex(F.substring(c, 1, 3)), F.lit(m[0])), m[1]).otherwise(rest), reversed(MARKS), F.when(F.is_valid_utf8(c.cast("string")), "UTF-8").otherwise("ISO-8859-1"))
    return F.when(c.isNull(), None).otherwise(marked)


def decoded(content) -> Column:
    """The text of the bytes, without a mark."""
    c, e = (F.col(content) if isinstance(content, str) else content), encoding(content)
    text = reduce(lambda rest, name: F.when(e == name, F.decode(c, name)).otherwise(rest), ("UTF-16LE", "UTF-16BE", "ISO-8859-1"), F.decode(c, "UTF-8"))
    return F.regexp_replace(text, "\\A\\x{FEFF}", "")


def upsert(table: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """The table after new rows took the place of those with their keys; of equal new keys the greatest row stays, column by column."""
    rest = [c for c in new.columns if c != key]
    fresh = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest)).select(*new.columns) if rest else new.distinct()
    return fresh if table is None else table.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions of a table, oldest first: folders v=<number> that hold a success marker."""
    fs, make = _file_system(spark, path)
    if not fs.exists(make(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(make(path)) if s.getPath().getName().startswith("v=")]
    done = [n for n in names if fs.exists(make(f"{path}/{n}/_SUCCESS"))]
    return [f"{path}/{n}" for n in sorted(done, key=lambda n: int(n[2:]))]


def replace_table(df: DataFrame, path: str, *partition: str, keep: int = 2) -> str:
    """Write df as the next version of the table at path. The version before stays readable until the new one is whole, and
    for one more round: a crash at any point leaves a whole table. Older versions are deleted. Returns the new folder."""
    spark = df.sparkSession
    held = versions(spark, path)
    new = f"{path}/v={int(held[-1].rpartition('=')[2]) + 1 if held else 1}"
    (df.write.partitionBy(*partition) if partition else df.write).mode("overwrite").parquet(new)
    fs, make = _file_system(spark, path)
    for old in versions(spark, path)[:-keep]:
        fs.delete(make(old), True)
    return new


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table that replace_table wrote."""
    held = versions(spark, path)
    if not held:
        raise FileNotFoundError(path)
    return spark.read.parquet(held[-1])
