"""Queries over indexes that are built in the shared folder, one for each call: vectors in lists, texts as posting blocks."""

from __future__ import annotations

from ..operators import text_index, vector_index
from ..storage import new_folder
from .registry import _ASKED_SQL, _BM25, _DENSE, _KEYWORD, _asked, _t, query


def _vectors(spark, d, **how):
    return vector_index.build(_t(spark, d, "embeddings", "vec_id", "embedding", "label"), new_folder(spark), "vec_id", keep=("label",), **how)


@query(f"WITH {_DENSE} SELECT * FROM (SELECT query_id, doc_id AS vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ds) WHERE rank <= 20")
def r1_indexed_search(spark, d):
    """The k best by way of the index, exact: after the first lists, all that may still hold one."""
    return vector_index.search(_vectors(spark, d), _asked(spark, d), 20, exact=True)


_LABELLED = _DENSE.replace("FROM embeddings, asked WHERE qv IS NOT NULL", "FROM embeddings, asked WHERE qv IS NOT NULL AND label IN (1, 3, 5)")


@query(f"WITH {_LABELLED} SELECT * FROM (SELECT query_id, doc_id AS vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ds WHERE score >= 0.1) WHERE rank <= 20")
def r1_filtered_index_search(spark, d):
    """Filter, threshold and search in one: the filter applies inside the lists, before the k best are chosen."""
    return vector_index.search(_vectors(spark, d), _asked(spark, d), 20, exact=True, least=0.1, filters={"label": [1, 3, 5]})


@query()
def r1_probed_search(spark, d):
    """The k best of the lists probed; a test measures the recall."""
    return vector_index.search(_vectors(spark, d), _asked(spark, d), 20, probes=16)


def _texts(spark, d):
    return text_index.build(_t(spark, d, "documents", "doc_id", "text"), new_folder(spark))


@query(f"WITH {_DENSE}, {_KEYWORD} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id)::INTEGER AS rank FROM ks) WHERE rank <= 20")
def r2_indexed_keyword_search(spark, d):
    return text_index.keyword_search(_texts(spark, d), _asked(spark, d))


@query(f"WITH {_ASKED_SQL}, {_BM25} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b) WHERE rank <= 20")
def g1_indexed_bm25(spark, d):
    return text_index.bm25_search(_texts(spark, d), _asked(spark, d))
