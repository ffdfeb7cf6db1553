"""Queries over stored state: the text index, the graph."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.stemming import stem_ctes
from ..operators import incremental, textindex
from ..operators.settle import scratch, settled
from ..sources import telemetry as T
from . import views as V
from .catalogue import _query

# ------------------------------------------------------------------ text index

_WORDS = f"""{V.LOGS}, halves AS (SELECT log_id, list_filter(string_split_regex(strip_accents(lower(coalesce(body, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS b,
 list_filter(string_split_regex(strip_accents(lower(coalesce(service_name, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS s FROM logs),
lens AS (SELECT log_id, len(b) + len(s) AS n FROM halves),
words AS (SELECT log_id, unnest(b) AS word, unnest(range(len(b))) AS pos FROM halves UNION ALL SELECT log_id, unnest(s), unnest(range(len(s))) + len(b) + 1 FROM halves),
{stem_ctes("words")},
terms AS (SELECT log_id, stem AS term, pos FROM words JOIN stems USING (word)), sums AS (SELECT count(*) AS docs, avg(n) AS mean FROM lens)"""


def _bm25_sql(parts: list[str]) -> str:
    """``parts``: for each word of the query, the SQL of (log_id, tf)."""
    ctes = ", ".join(f"t{i} AS ({p}), d{i} AS (SELECT CASE WHEN ln((docs - c + 0.5) / (c + 0.5)) > 0 THEN ln((docs - c + 0.5) / (c + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT count(*) AS c FROM t{i}), sums)" for i, p in enumerate(parts))
    score = " + ".join(f"d{i}.idf * t{i}.tf * 2.2 / (t{i}.tf + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(parts)))
    joins = " ".join(f"JOIN t{i} ON t{i}.log_id = lens.log_id" for i in range(len(parts)))
    return f"WITH {_WORDS}, {ctes} SELECT lens.log_id, round({score}, 6) AS score FROM lens {joins}, sums, {', '.join(f'd{i}' for i in range(len(parts)))}"


def _prefixed(prefix: str, where: str = "true") -> str:
    return f"SELECT log_id, count(*) AS tf FROM terms WHERE starts_with(term, '{prefix}') AND {where} GROUP BY 1"


def _built(spark, d):
    """An index of the logs in three segments."""
    logs, path = T.document_logs(spark, d), f"{scratch(spark)}/text-index-{uuid.uuid4().hex}"
    for k in range(3):
        textindex.append(logs.where(F.col("log_id") % 3 == k), path, k)
    return logs, path


@_query(_bm25_sql([_prefixed("licens"), _prefixed("the")]))
def log_search_index(spark, d):
    _, path = _built(spark, d)
    return textindex.search(spark, path, "Licensing the").withColumn("score", F.round("score", 6))


@_query(_bm25_sql(["SELECT a.log_id, count(DISTINCT a.pos) AS tf FROM terms a JOIN terms b ON b.log_id = a.log_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND starts_with(b.term, 'th') GROUP BY 1"]))
def log_search_phrase(spark, d):
    _, path = _built(spark, d)
    return textindex.search(spark, path, "of/th").withColumn("score", F.round("score", 6))


@_query(f"WITH {_WORDS} SELECT term, count(DISTINCT log_id)::BIGINT AS docs, count(*)::BIGINT AS n FROM terms GROUP BY 1")
def log_index_terms(spark, d):
    return textindex.postings(T.document_logs(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("positions")).alias("n"))


# ------------------------------------------------------------------ stored graph


def _advanced(spark, d):
    """The graph of the orders, folded in four times: up to three moments, and whole; their lines are numbered once."""
    spans, path = settled(T.order_spans(spark, d)), f"{scratch(spark)}/graph-{uuid.uuid4().hex}"
    for upto in (datetime(1994, 6, 1), datetime(1996, 1, 1), datetime(1997, 3, 1), None):
        incremental.advance(spans, path, upto)
    return path


@_query(f"WITH {V.ORD}, {V.CALLS} SELECT tenant_id, caller, callee, count(*)::BIGINT AS n, (count(*) FILTER ({V.ERROR}))::BIGINT AS errors, sum(duration_us)::BIGINT AS duration_sum FROM calls GROUP BY 1, 2, 3")
def graph_edges_advanced(spark, d):
    return incremental.graph(spark, _advanced(spark, d), "edges").drop("first_seen", "last_seen")


@_query(f"WITH {V.ORD} SELECT tenant_id, service_name, operation_name, count(*)::BIGINT AS n, (count(*) FILTER ({V.ERROR}))::BIGINT AS errors, sum(duration_us)::BIGINT AS duration_sum FROM spans GROUP BY 1, 2, 3")
def graph_nodes_advanced(spark, d):
    return incremental.graph(spark, _advanced(spark, d), "nodes").drop("first_seen", "last_seen")
