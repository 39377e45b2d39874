"""Table functions for SQL: the chunker as one that takes a table, in parts and in order."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.functions import OrderingColumn, PartitioningColumn
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunk import merge_pieces, split_pieces, tokens


class SectionChunks:
    """section_chunks(TABLE(sections), key => 'doc_id', size => 512, overlap => 64): recursive chunks of each document's sections.

    The table has the key, section_no and text. Rows come by document and in order of sections; chunks do not cross
    sections, and are numbered over the document. A document's sections pass one at a time.
    """

    def __init__(self):
        self.at = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        held = {f.name: f.dataType for f in table.dataType}
        if missing := {key.value, "section_no", "text"} - set(held):
            raise ValueError(f"section_chunks needs {sorted(missing)}")

        schema = StructType()
        for name, kind in ((key.value, held[key.value]), ("section_no", held["section_no"]), ("chunk_index", LongType()), ("chunk_id", StringType()), ("text", StringType()), ("token_count", LongType())):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn("section_no")])

    def eval(self, row, key: str, size: int = 512, overlap: int = 64):
        doc, text = row[key], row["text"]
        for piece in merge_pieces(split_pieces(text, size), size, overlap) if text and text.strip() else []:
            name = hashlib.md5(f"{doc}|recursive|{self.at}".encode()).hexdigest()
            yield doc, row["section_no"], self.at, name, piece, tokens(piece)
            self.at += 1


def register(spark: SparkSession) -> None:
    """Make the table functions known to this session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("section_chunks", udtf(SectionChunks))
