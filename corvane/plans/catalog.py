"""Registered queries of the library's own operators, with independent SQL where SQL can express them."""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pooling, text, vectors
from ..functions import tables as functions
from ..operators import cells, directions, draws, failures, fits, knn, linalg, metrics, setsim
from ..operators.contrastive import contrastive
from ..sources import cache, npy, tables
from ..sources.stage import shared_folder, staged
from . import workloads
from .workloads import queries_of, scored_pairs

TAU = 0.3
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(df: DataFrame, places: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def _emb(spark, d):
    return workloads.vectors(spark, d)


# parts of the SQL that several queries share
E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
U = E + ", u AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + CAST(1e-12 AS DOUBLE))) AS v, label FROM e)"
PAIRS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(5 AS DOUBLE) - abs(a.label - b.label) * CAST(5 AS DOUBLE) / 9 AS gold FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"
KNN = """k AS (SELECT * FROM (
  SELECT a.vec_id AS anchor_id, b.vec_id AS neighbor_id, list_dot_product(a.v, b.v) AS sim,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rank
  FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= 10)"""
TOP = """t AS (SELECT * FROM (
  SELECT a.vec_id AS anchor_id, b.vec_id AS neighbor_id, list_dot_product(a.v, b.v) AS sim,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rank
  FROM e a CROSS JOIN e b WHERE a.vec_id % 100 = 0) WHERE rank <= 10)"""
REL = "rel AS (SELECT a.vec_id AS query_id, b.vec_id AS corpus_id FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"
PER = f"""{TOP}, {REL}, n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
h AS (SELECT query_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM t JOIN rel ON anchor_id = query_id AND neighbor_id = corpus_id GROUP BY 1),
q AS (SELECT query_id, n_rel, coalesce(hits, 0) AS hits, coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= n_rel) AS ndcg,
      coalesce(hits, 0) / CAST(least(n_rel, 10) AS DOUBLE) AS recall FROM n LEFT JOIN h USING (query_id))"""


# --- vectors


def _spread(df: DataFrame, key: str, vec, out: str, places: int = 6) -> DataFrame:
    """One row per component, which every engine compares alike."""
    return df.select(key, F.posexplode(vec).alias("pos", "x")).select(key, "pos", F.round("x", places).alias(out))


@query(f"WITH {U} SELECT vec_id, CAST(unnest(range(0, len(v))) AS INT) AS pos, round(unnest(v), 6) AS unit FROM u")
def l2_normalize(spark, d):
    return _spread(_emb(spark, d), "vec_id", vectors.normalize_added("embedding"), "unit")


@query(f"WITH {U} SELECT vec_id, CAST(unnest(range(0, len(v))) AS INT) AS pos, round(unnest(v), 6) AS unit FROM u")
def l2_normalize_clamped(spark, d):
    return _spread(_emb(spark, d), "vec_id", vectors.normalize_clamped("embedding"), "unit")


@query(f"WITH {U}, {PAIRS} SELECT p.a, p.b, round(list_dot_product(x.v, y.v), 6) AS cos FROM p JOIN u x ON x.vec_id = a JOIN u y ON y.vec_id = b")
def cosine_pairs(spark, d):
    emb = _emb(spark, d)
    return _r(metrics.pair_cosines(scored_pairs(emb), emb).select("a", "b", "cos"), 6, "cos")


# --- neighbours


@query(f"WITH {E}, {KNN} SELECT anchor_id, neighbor_id, rank, round(sim, 6) AS sim FROM k")
def self_knn_top10(spark, d):
    return _r(knn.self_knn(_emb(spark, d), 10), 6, "sim")


@query(f"WITH {E}, {KNN} SELECT anchor_id, neighbor_id, rank, round(sim, 6) AS sim FROM k")
def self_knn_cells(spark, d):
    """The same search over cells around pivots, of which pairs too far apart are skipped."""
    return _r(cells.cell_self_knn(_emb(spark, d), 10), 6, "sim")


@query(f"WITH {E}, {TOP} SELECT anchor_id, neighbor_id, CAST(rank AS INT) AS rank, round(sim, 6) AS sim FROM t WHERE rank <= 3")
def topk_table_function(spark, d):
    """The best three results of each query, chosen by the table function in SQL text."""
    emb = _emb(spark, d)
    functions.register(spark)
    knn.topk_join(queries_of(emb), emb, 10).createOrReplaceTempView("corvane_found")
    return _r(spark.sql("SELECT * FROM topk(3, TABLE(SELECT anchor_id, neighbor_id, sim FROM corvane_found) PARTITION BY anchor_id)"), 6, "sim")


@query(f"WITH {E}, {KNN} SELECT anchor_id, neighbor_id, rank, round(sim, 6) AS sim FROM k WHERE sim >= {TAU}")
def knn_tau_filter(spark, d):
    return _r(knn.tau_filter(knn.self_knn(_emb(spark, d), 10), TAU), 6, "sim")


@query(f"WITH {E}, {KNN} SELECT anchor_id, array_to_string(list(neighbor_id ORDER BY rank)[1:5], ',') AS neighbors FROM k WHERE sim >= {TAU} GROUP BY 1")
def mined_positive_sets(spark, d):
    return knn.mined_sets(knn.self_knn(_emb(spark, d), 10), TAU, 5).withColumn("neighbors", F.array_join("neighbors", ","))


@query(f"WITH {E}, {KNN} SELECT anchor_id AS a, neighbor_id AS b FROM k UNION SELECT neighbor_id, anchor_id FROM k")
def mutual_edges_union(spark, d):
    return knn.symmetric_edges(knn.self_knn(_emb(spark, d), 10))


@query(f"WITH {E}, {TOP} SELECT anchor_id, neighbor_id, rank, round(sim, 6) AS sim FROM t")
def retrieval_top10(spark, d):
    emb = _emb(spark, d)
    return _r(knn.topk_join(queries_of(emb), emb, 10), 6, "sim")


# --- retrieval metrics


def _per_query(spark, d):
    emb = _emb(spark, d)
    return metrics.label_retrieval(knn.topk_join(queries_of(emb), emb, 10), queries_of(emb), emb, 10)


@query(f"WITH {E}, {PER} SELECT round(avg(ndcg) * 100, 4) AS ndcg, count(*) AS n FROM q")
def ndcg10(spark, d):
    return _r(metrics.retrieval_means(_per_query(spark, d)).select("ndcg", "n"), 4, "ndcg")


@query(f"WITH {E}, {PER} SELECT query_id, n_rel, hits, round(ndcg, 6) AS ndcg FROM q")
def ndcg10_per_query(spark, d):
    return _r(_per_query(spark, d).select("query_id", "n_rel", "hits", "ndcg"), 6, "ndcg")


@query(f"WITH {E}, {PER} SELECT round(avg(recall) * 100, 4) AS recall, count(*) AS n FROM q")
def recall10(spark, d):
    return _r(metrics.retrieval_means(_per_query(spark, d)).select("recall", "n"), 4, "recall")


@query(f"WITH {E}, {PER} SELECT round(avg(hits / CAST(10 AS DOUBLE)), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END), 6) AS hit_rate, count(*) AS n FROM q")
def prec_recall_hit(spark, d):
    out = metrics.retrieval_means(_per_query(spark, d)).select("precision", (F.col("recall") / 100).alias("recall"), "hit_rate", "n")
    return _r(out, 6, "precision", "recall", "hit_rate")


@query(f"""WITH {E}, {KNN}, {PAIRS}, g AS (SELECT a AS anchor, b AS partner FROM p WHERE gold >= 4 UNION SELECT b, a FROM p WHERE gold >= 4),
n AS (SELECT anchor, count(*) AS n_gold FROM g GROUP BY 1),
m AS (SELECT anchor_id, count(*) AS mined, count(partner) AS h FROM k LEFT JOIN g ON anchor_id = anchor AND neighbor_id = partner WHERE sim >= 0.2 GROUP BY 1)
SELECT round(avg(h / CAST(mined AS DOUBLE)), 6) AS precision, round(avg(h / CAST(least(n_gold, 10) AS DOUBLE)), 6) AS recall,
       round(avg(CASE WHEN h > 0 THEN 1 ELSE 0 END), 6) AS hit_rate, count(*) AS n FROM m JOIN n ON anchor_id = anchor""")
def mined_prec_sentences(spark, d):
    emb = _emb(spark, d)
    return _r(metrics.mined_precision(knn.self_knn(emb, 10), metrics.gold_partners(scored_pairs(emb), 4.0), 10, 0.2), 6, "precision", "recall", "hit_rate")


@query(f"WITH {E}, {PAIRS} SELECT a AS anchor, b AS partner FROM p WHERE gold >= 4 UNION SELECT b, a FROM p WHERE gold >= 4")
def gold_partner_sets(spark, d):
    return metrics.gold_partners(scored_pairs(_emb(spark, d)), 4.0)


@query(f"""WITH {U}, {PAIRS}, c AS (SELECT gold, round(list_dot_product(x.v, y.v), 12) AS cos FROM p JOIN u x ON x.vec_id = a JOIN u y ON y.vec_id = b),
r AS (SELECT rank() OVER (ORDER BY gold) + (count(*) OVER (PARTITION BY gold) - 1) / CAST(2 AS DOUBLE) AS rg,
             rank() OVER (ORDER BY cos) + (count(*) OVER (PARTITION BY cos) - 1) / CAST(2 AS DOUBLE) AS rc FROM c)
SELECT round(corr(rg, rc) * 100, 4) AS spearman FROM r""")
def spearman_pairs(spark, d):
    emb = _emb(spark, d)
    return _r(metrics.spearman(_r(metrics.pair_cosines(scored_pairs(emb), emb), 12, "cos"), "gold", "cos"), 4, "spearman")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / CAST(2 AS DOUBLE) AS a,
rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / CAST(2 AS DOUBLE) AS b FROM lineitem)
SELECT round(corr(a, b) * 100, 4) AS spearman FROM r""")
def spearman_ties(spark, d):
    return _r(metrics.spearman(tables.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 4, "spearman")


# --- moments and geometry


@query(f"WITH {E} SELECT CAST(pos - 1 AS INT) AS pos, round(avg(x), 6) AS mean FROM (SELECT unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS x FROM e) GROUP BY pos")
def mean_vector(spark, d):
    return _r(linalg.mean_vector(_emb(spark, d)), 6, "mean")


X = "x AS (SELECT vec_id, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM {0}), c AS (SELECT CAST(l.i AS INT) AS i, CAST(r.i AS INT) AS j, covar_samp(l.x, r.x) AS cov FROM x l JOIN x r USING (vec_id) GROUP BY ALL)"


@query(f"WITH {E}, {X.format('e')} SELECT i, j, round(cov, 8) AS cov FROM c")
def covariance(spark, d):
    return _r(linalg.covariance_frame(_emb(spark, d)), 8, "cov")


@query(f"WITH {E}, {X.format('e')}, t AS (SELECT sum(cov) / count(*) AS t FROM c WHERE i = j) SELECT i, j, round(0.92 * cov + CASE WHEN i = j THEN 0.08 * t ELSE 0 END, 8) AS cov FROM c, t")
def shrink_cov(spark, d):
    return _r(linalg.covariance_frame(_emb(spark, d), shrinkage=0.08), 8, "cov")


@query(f"WITH {U} SELECT round(sqrt(sum(m * m)), 6) AS anisotropy_mean FROM (SELECT avg(x) AS m FROM (SELECT unnest(range(0, len(v))) AS i, unnest(v) AS x FROM u) GROUP BY i)")
def anisotropy_mean(spark, d):
    return _r(metrics.anisotropy(_emb(spark, d)), 6, "anisotropy_mean")


@query(f"WITH {U}, {PAIRS} SELECT round(avg(list_dot_product(x.v, y.v)), 6) AS self_sim FROM p JOIN u x ON x.vec_id = a JOIN u y ON y.vec_id = b")
def self_similarity(spark, d):
    emb = _emb(spark, d)
    return _r(metrics.self_similarity(emb, scored_pairs(emb).select("a", "b")), 6, "self_sim")


@query(f"""WITH {U}, {X.format('u')}, m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY 1)
SELECT (SELECT round(sqrt(sum(m * m)), 6) FROM m) AS anisotropy_mean,
       (SELECT round(sum(CASE WHEN i <> j THEN abs(cov) ELSE 0 END) / count(*), 6) FROM c) AS offdiag_cov, (SELECT round(avg(s), 6) FROM m) AS avg_feature_std""")
def geom_diag(spark, d):
    return _r(metrics.geometry(_emb(spark, d)), 6, "anisotropy_mean", "offdiag_cov", "avg_feature_std")


DIST = """round(avg({0}), 4) AS mean, round(quantile_cont({0}, 0.5), 4) AS median, round(quantile_cont({0}, 0.25), 4) AS p25, round(quantile_cont({0}, 0.75), 4) AS p75,
round(avg(CASE WHEN {0} >= 4.0 THEN 1 ELSE 0 END) * 100, 4) AS pct_ge_4_0, round(avg(CASE WHEN {0} >= 4.5 THEN 1 ELSE 0 END) * 100, 4) AS pct_ge_4_5, count({0}) AS n"""
DCOLS = ("mean", "median", "p25", "p75", "pct_ge_4_0", "pct_ge_4_5")


@query(f"WITH {E}, {PAIRS} SELECT {DIST.format('gold')} FROM p")
def dist_stats(spark, d):
    return _r(metrics.distribution(scored_pairs(_emb(spark, d)), "gold"), 4, *DCOLS)


ALLNEAR = """m AS (SELECT a.vec_id AS anchor_id, b.vec_id AS neighbor_id FROM e a JOIN e b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) <= 40)"""


@query(f"WITH {E}, {ALLNEAR}, {PAIRS}, s AS (SELECT gold FROM m JOIN p ON least(anchor_id, neighbor_id) = a AND greatest(anchor_id, neighbor_id) = b) SELECT {DIST.format('gold')} FROM s")
def neighbor_score_dist(spark, d):
    emb = _emb(spark, d)
    gold = metrics.last_wins(scored_pairs(emb).withColumn("ord", F.col("a")), "a", "b", "gold", "ord")
    return _r(metrics.distribution(metrics.mined_scores(knn.self_knn(emb, 40), gold), "score"), 4, *DCOLS)


# --- text

TOK = r"tok AS (SELECT {id} AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS t FROM {table})"


@query(f"""WITH {TOK.format(id='doc_id', table='documents')}, r AS (SELECT min(id) AS id, t FROM tok WHERE len(t) > 0 GROUP BY t),
w AS (SELECT id, len(t) AS n, unnest(t) AS w FROM r),
c AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.id < b.id AND a.n >= 0.5 * b.n AND b.n >= 0.5 * a.n GROUP BY 1, 2)
SELECT a, b, round(k / CAST(na + nb - k AS DOUBLE), 6) AS jaccard FROM c WHERE k / CAST(na + nb - k AS DOUBLE) >= 0.5 - 1e-12""")
def jaccard_pairs(spark, d):
    return _r(setsim.jaccard_join(tables.table(spark, d, "documents"), 0.5, "doc_id", "text"), 6, "jaccard")


@query(f"WITH {TOK.format(id='doc_id', table='documents')} SELECT id, min(id) OVER (PARTITION BY t) AS class_id FROM tok WHERE len(t) > 0")
def token_set_classes(spark, d):
    return setsim.classes(tables.table(spark, d, "documents"), "doc_id", "text").select("id", "class_id")


@query(f"""WITH {TOK.format(id='doc_id', table='documents')}, r AS (SELECT min(id) AS id, t FROM tok WHERE len(t) > 0 GROUP BY t), w AS (SELECT id, len(t) AS n, unnest(t) AS w FROM r),
c AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.id < b.id AND a.n >= 0.5 * b.n AND b.n >= 0.5 * a.n GROUP BY 1, 2),
j AS (SELECT a, b, round(k / CAST(na + nb - k AS DOUBLE), 3) AS lexical_overlap FROM c WHERE k / CAST(na + nb - k AS DOUBLE) >= 0.5)
SELECT a, b, lexical_overlap, 'not_duplicate' AS gold FROM j ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = a ORDER BY lexical_overlap DESC, a, b LIMIT 30""")
def failure_cases(spark, d):
    """The 30 lexically closest pairs whose first text isn't judged low, as a report lists them."""
    near = setsim.jaccard_join(tables.table(spark, d, "documents"), 0.5, "doc_id", "text")
    judged = tables.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("a"))
    out = near.join(judged, "a", "left_anti").select("a", "b", F.round("jaccard", 3).alias("lexical_overlap"), F.lit("not_duplicate").alias("gold"))
    return out.orderBy(F.desc("lexical_overlap"), "a", "b").limit(30)


JAC = r"coalesce(len(list_intersect(x.t, y.t)) / CAST(nullif(len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)), 0) AS DOUBLE), 0)"
CASE = f"""rank, round(sim, 4) AS cosine_similarity, round({JAC}, 3) AS lexical_overlap"""


def _case_cols(df):
    return df.select("anchor_id", "neighbor_id", "gold_label_or_score", F.col("rank").cast("long").alias("rank"), "cosine_similarity", "lexical_overlap")


def _doc_texts(spark, d):
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"""WITH {E}, {PAIRS}, {ALLNEAR.replace('AS neighbor_id FROM', 'AS neighbor_id, list_dot_product(a.v, b.v) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rank FROM')}, {TOK.format(id='doc_id', table='documents')}
SELECT anchor_id, neighbor_id, CAST(round(gold, 4) AS VARCHAR) AS gold_label_or_score, {CASE} FROM m JOIN p ON least(anchor_id, neighbor_id) = a AND greatest(anchor_id, neighbor_id) = b
JOIN tok x ON x.id = anchor_id JOIN tok y ON y.id = neighbor_id WHERE sim >= 0 AND gold <= 4.5 AND {JAC} >= 0.02 ORDER BY lexical_overlap DESC, cosine_similarity DESC, anchor_id, neighbor_id LIMIT 30""")
def failure_cases_scored(spark, d):
    """Neighbours of a pair that is scored low, though their texts share words."""
    emb = _emb(spark, d)
    gold = metrics.last_wins(scored_pairs(emb).withColumn("ord", F.col("a")), "a", "b", "gold", "ord").withColumn("score", F.round("score", 4))
    return _case_cols(failures.first(failures.scored_failures(knn.self_knn(emb, 40), _doc_texts(spark, d), gold, 0.0, 4.5, 0.02)))


@query(f"""WITH {E}, {TOP}, {REL}, {TOK.format(id='doc_id', table='documents')}
SELECT anchor_id, neighbor_id, 'not_duplicate' AS gold_label_or_score, {CASE} FROM t ANTI JOIN rel ON anchor_id = query_id AND neighbor_id = corpus_id
JOIN tok x ON x.id = anchor_id JOIN tok y ON y.id = neighbor_id WHERE {JAC} >= 0.02 ORDER BY lexical_overlap DESC, cosine_similarity DESC, anchor_id, neighbor_id LIMIT 30""")
def failure_cases_search(spark, d):
    """Results that are no judged answer, though their texts share words."""
    emb, texts = _emb(spark, d), _doc_texts(spark, d)
    ranked = staged(knn.topk_join(queries_of(emb), emb, 10), "ranked")  # read twice
    return _case_cols(failures.first(failures.label_unjudged_failures(ranked, texts, texts, emb, jac_min=0.02)))


@query("SELECT text FROM documents UNION SELECT text FROM benchmark")
def distinct_sentences(spark, d):
    a, b = tables.table(spark, d, "documents"), tables.table(spark, d, "benchmark")
    return a.select("text").union(b.select("text")).distinct()


@query("SELECT text FROM documents UNION ALL SELECT text FROM benchmark")
def train_plus_test_union(spark, d):
    return tables.table(spark, d, "documents").select("text").unionAll(tables.table(spark, d, "benchmark").select("text"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti(spark, d):
    return tables.missing(tables.table(spark, d, "documents").select("doc_id"), tables.table(spark, d, "labels"), "doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS query_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_queries(spark, d):
    q = tables.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"))
    return tables.judged_queries(q, tables.table(spark, d, "labels").select(F.col("doc_id").alias("query_id")))


@query("SELECT row_number() OVER (ORDER BY l.doc_id DESC) AS pos, l.doc_id, d.lang FROM labels l JOIN documents d USING (doc_id)")
def ordered_subset(spark, d):
    wanted = tables.table(spark, d, "labels").select("doc_id")
    ranked = metrics.average_ranks(wanted.withColumn("neg", (-F.col("doc_id")).cast("double")), "neg", "r").select(F.col("r").cast("long").alias("pos"), "doc_id")
    return tables.ordered_subset(ranked, tables.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS covered")
def superset_test(spark, d):
    rest = tables.table(spark, d, "labels").select("doc_id").subtract(tables.table(spark, d, "documents").select("doc_id"))
    return rest.agg((F.count(F.lit(1)) == 0).alias("covered"))


@query("SELECT label AS query_id, array_to_string(list(DISTINCT vec_id ORDER BY vec_id), ',') AS docs FROM embeddings GROUP BY 1")
def qrels_group(spark, d):
    return tables.grouped_qrels(_emb(spark, d).select(F.col("label").alias("query_id"), F.col("vec_id").alias("corpus_id"))).withColumn("docs", F.array_join("docs", ","))


@query("SELECT toxic AS query_id, string_agg(doc_id || ':' || quality, ',' ORDER BY doc_id) AS grades FROM labels GROUP BY 1")
def graded_qrels(spark, d):
    """Grades stay beside their documents; a grade of 0 is a judgment too."""
    q = tables.table(spark, d, "labels").select(F.col("toxic").alias("query_id"), F.col("doc_id").alias("corpus_id"), F.col("quality").alias("score"))
    entries = F.transform(F.array_sort(F.map_entries("grades")), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string")))
    return tables.grouped_qrels(q, graded=True).select("query_id", F.array_join(entries, ",").alias("grades"))


@query("SELECT least(o_custkey, o_orderkey % 1000) AS lo, greatest(o_custkey, o_orderkey % 1000) AS hi, max_by(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1, 2")
def last_wins_gold(spark, d):
    o = tables.table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 1000).alias("other"), "o_totalprice", "o_orderkey")
    return metrics.last_wins(o, "o_custkey", "other", "o_totalprice", "o_orderkey")


@query("""SELECT item_id, text AS plain, 'This sentence: "' || text || '" means in one word:"' AS eol_a, 'This sentence: "' || text || '" means:"' AS eol_b, text || ' ' || text AS echo FROM benchmark""")
def prompt_format(spark, d):
    b = tables.table(spark, d, "benchmark")
    names = dict(zip(("plain", "eol_a", "eol_b", "echo"), text.TEMPLATES.values(), strict=True))
    return b.select("item_id", *[text.templated(t, "text").alias(n) for n, t in names.items()])


@query(r"SELECT page_id, regexp_replace(regexp_replace(coalesce(url, '') || ' ' || coalesce(html, ''), '^\s+', ''), '\s+$', '') AS text FROM pages")
def title_body_concat(spark, d):
    return tables.table(spark, d, "pages").select("page_id", text.title_body("url", "html").alias("text"))


@query(r"SELECT doc_id, line FROM (SELECT doc_id, regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '^\s+', ''), '\s+$', '') AS line FROM documents) WHERE line <> ''")
def clean_lines(spark, d):
    rows = tables.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.select("doc_id", text.strip("line").alias("line")).where(F.length("line") > 0)


@query("SELECT item_id, least(lo, hi) AS lo, greatest(lo, hi) AS hi FROM (SELECT item_id, text AS lo, reverse(text) AS hi FROM benchmark)")
def unordered_pair_key(spark, d):
    k = text.pair_key("text", F.reverse("text"))
    return tables.table(spark, d, "benchmark").select("item_id", k["lo"].alias("lo"), k["hi"].alias("hi"))


# --- pooling: turns of a conversation are tokens, with three length features; a turn of the system is masked

H = "[length(text), length(text) % 7, turn]"


def _tokens(spark, d):
    h = F.array(F.length("text").cast("float"), (F.length("text") % 7).cast("float"), F.col("turn").cast("float"))
    t = tables.table(spark, d, "conversations").select("conv_id", F.struct(F.col("turn").cast("int").alias("pos"), F.when(F.col("role") == "system", 0).otherwise(1).alias("mask"), h.alias("h")).alias("t"))
    return t.groupBy("conv_id").agg(F.collect_list("t").alias("tokens"))


def _pooled(df, vec):
    x = df.select("conv_id", vec.alias("v")).where("size(v) > 0")
    return x.select("conv_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


M = f"t AS (SELECT conv_id, turn, CAST({H} AS DOUBLE[]) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'system')"


@query(f"WITH {M} SELECT conv_id, round(avg(h[1]), 6) AS p0, round(avg(h[2]), 6) AS p1, round(avg(h[3]), 6) AS p2 FROM t GROUP BY 1")
def pool_mean(spark, d):
    return _pooled(_tokens(spark, d), pooling.mean_pool("tokens"))


@query(f"WITH {M} SELECT conv_id, h[1] AS p0, h[2] AS p1, h[3] AS p2 FROM t WHERE back = 1")
def pool_last(spark, d):
    return _pooled(_tokens(spark, d), pooling.last_pool("tokens"))


@query(f"WITH {M} SELECT conv_id, h[1] AS p0, h[2] AS p1, h[3] AS p2 FROM t WHERE back = least(n, 2)")
def pool_second_last(spark, d):
    return _pooled(_tokens(spark, d), pooling.second_last_pool("tokens"))


# --- encoders: the states, poolings and scores of encoded documents


def _source_sql(name: str, e) -> str:
    before, _, after = text.TEMPLATES[e.template].partition("{sentence}")
    q = lambda x: "'" + x.replace("'", "''") + "'"
    full = f"replace({q(text.TEMPLATES[e.template])}, '{{sentence}}', text)"
    pool = "avg(h)" if e.pool == "mean" else "arg_max(h, i)"
    return f"""SELECT {q(name)} AS source, id, j, {pool} AS x FROM (
  SELECT id, i, j, c + CASE WHEN i > 1 THEN 0.5 * lag(c) OVER (PARTITION BY id, j ORDER BY i) ELSE 0 END AS h FROM (
    SELECT id, i, j, (CAST('0x' || substr(md5('{e.layer}:' || w), 2 * j + 1, 2) AS INT) - CAST(127.5 AS DOUBLE)) / 127.5 AS c FROM (
      SELECT id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS w FROM (
        SELECT doc_id AS id, list_filter(regexp_split_to_array({full}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')[1:128] AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)), range(0, 16) r(j))) GROUP BY 2, 3"""


def _sources_sql(sources: dict) -> str:
    return f"""WITH s AS ({" UNION ALL ".join(_source_sql(n, e) for n, e in sources.items())}),
{TOK.format(id='doc_id', table='documents WHERE doc_id IS NOT NULL AND text IS NOT NULL')},
p AS (SELECT x.id AS a, y.id AS b, 5 * {JAC} AS gold FROM tok x JOIN tok y ON y.id = x.id + 1 WHERE x.id % 2 = 0),
c AS (SELECT u.source, p.a, any_value(gold) AS gold, round(sum(u.x * v.x) / sqrt(sum(u.x * u.x)) / sqrt(sum(v.x * v.x)), 9) AS cos FROM p JOIN s u ON u.id = a JOIN s v ON v.id = b AND u.j = v.j AND u.source = v.source GROUP BY 1, 2),
r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY gold) + (count(*) OVER (PARTITION BY source, gold) - 1) / CAST(2 AS DOUBLE) AS rg,
             rank() OVER (PARTITION BY source ORDER BY cos) + (count(*) OVER (PARTITION BY source, cos) - 1) / CAST(2 AS DOUBLE) AS rc FROM c)
SELECT source, round(corr(rg, rc) * 100, 4) AS spearman FROM r GROUP BY source"""


def _sources(sources: dict):
    def run(spark, d):
        pairs = staged(workloads.document_pairs(spark, d), "pairs")
        rows = []
        for name, e in sources.items():
            cos = _r(metrics.pair_cosines(pairs, workloads.encoded(spark, d, e)), 9, "cos")
            rows.append(_r(metrics.spearman(cos, "gold", "cos"), 4, "spearman").select(F.lit(name).alias("source"), "spearman"))
        return workloads._all(rows)

    return run


LAYER_SOURCES = {f"{n}/{p}": replace(e, layer=i) for n, i in workloads.LAYERS.items() for p, e in workloads.POOLINGS.items()}
for _name, _sources_ in (("prompt_source_scores", workloads.PROMPTS), ("pooling_scores", workloads.POOLINGS), ("layer_scores", LAYER_SOURCES)):
    Q[_name], SQL[_name] = _sources(_sources_), _sources_sql(_sources_)


# --- roll-ups of result rows; order aggregates stand in for results

RES = "r AS (SELECT o_orderpriority AS method, year(o_orderdate) AS seed, o_orderstatus AS dataset, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2, 3)"


def _results(spark, d):
    o = tables.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("method"), F.year("o_orderdate").cast("long").alias("seed"), F.col("o_orderstatus").alias("dataset")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@query(f"WITH {RES} SELECT method, dataset, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(*) AS n FROM r GROUP BY 1, 2")
def seed_mean_std(spark, d):
    return _r(metrics.seed_summary(_results(spark, d), ["method", "dataset"], "value"), 4, "mean", "std")


@query(f"WITH {RES} SELECT method, seed, round(avg(value), 4) AS average, count(DISTINCT dataset) AS n FROM r GROUP BY 1, 2 HAVING count(DISTINCT dataset) = 3")
def complete_group_avg(spark, d):
    return _r(metrics.complete_average(_results(spark, d), ["method", "seed"], "dataset", "value", 3), 4, "average")


@query(f"""WITH {RES}, w AS (SELECT method, seed, max(CASE WHEN dataset = 'F' THEN value END) AS base, max(CASE WHEN dataset = 'O' THEN value END) AS refit, max(CASE WHEN dataset = 'P' THEN value END) AS transfer FROM r GROUP BY 1, 2)
SELECT method, seed, transfer, round(refit - transfer, 4) AS drop_vs_refit, transfer > base AS still_above_base FROM w""")
def transfer_vs_refit(spark, d):
    modes = F.create_map(*[F.lit(x) for x in ("F", "base", "O", "refit", "P", "transfer")])
    rows = _results(spark, d).withColumn("mode", modes[F.col("dataset")])
    return _r(metrics.transfer(rows, ["method", "seed"], "mode", "value"), 4, "drop_vs_refit")


@query(f"WITH {RES}, s AS (SELECT method, dataset, avg(value) AS value FROM r GROUP BY 1, 2) SELECT method, round(max(CASE WHEN dataset = 'F' THEN value END), 2) AS F, round(max(CASE WHEN dataset = 'O' THEN value END), 2) AS O, round(max(CASE WHEN dataset = 'P' THEN value END), 2) AS P FROM s GROUP BY 1")
def ablation_pivot(spark, d):
    rows = _results(spark, d).groupBy("method", "dataset").agg(F.avg("value").alias("value"))
    return metrics.wide_table(rows, "method", "dataset", ["F", "O", "P"], "value")


@query(f"WITH {RES} SELECT dataset, seed, value FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, seed) AS k FROM (SELECT dataset, seed, round(avg(value), 4) AS value FROM r GROUP BY 1, 2)) WHERE k = 1")
def best_layer(spark, d):
    rows = _results(spark, d).groupBy("dataset", "seed").agg(F.round(F.avg("value"), 4).alias("value"))
    return metrics.best_by(rows, ["dataset"], "value", "seed", "seed")


@query(f"""WITH {RES}, s AS (SELECT dataset, method, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM r GROUP BY 1, 2)
SELECT a.dataset, a.method, a.mean, round(a.mean - b.mean, 4) AS gap, round(a.mean - b.mean, 4) > greatest(a.std, b.std, CAST(0.2 AS DOUBLE)) AS clear FROM s a JOIN s b ON a.dataset = b.dataset AND b.method = '1-URGENT' WHERE a.method <> '1-URGENT'""")
def gap_vs_random(spark, d):
    rows = _r(metrics.seed_summary(_results(spark, d), ["dataset", "method"], "value"), 4, "mean", "std")
    return _r(metrics.gap_to(rows, ["dataset"], "method", "1-URGENT", "mean", "std"), 4, "gap")


#: Numbers of vectors in the fixtures: the draws for these are written out in SQL, where the generator can't be called.
SIZES = (500, 2000)


def _draws(draw) -> str:
    """(n, i, a, b): the drawn rows for each number of vectors."""
    lists = {n: np.atleast_2d(draw(n)) for n in SIZES}
    lit = lambda x: "[" + ",".join(map(str, x.tolist())) + "]"
    parts = [f"SELECT {n} AS n, unnest(range(0, {x.shape[1]})) AS i, unnest({lit(x[0])}) AS a, unnest({lit(x[-1])}) AS b" for n, x in lists.items()]
    return "draws AS (SELECT i, a, b FROM (" + " UNION ALL ".join(parts) + ") WHERE n = (SELECT count(*) FROM embeddings)), places AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings)"


@query(f"WITH {_draws(lambda n: np.random.RandomState(42).choice(n, 100, replace=False))} SELECT CAST(i AS INT) AS draw, vec_id FROM draws JOIN places ON k = a")
def seeded_sample(spark, d):
    """The vectors at the positions that the seeded draw picks, in draw order."""
    return cache.drawn(_emb(spark, d).select("vec_id"), "vec_id", 100).select("draw", "vec_id").orderBy("draw")


@query(f"WITH RECURSIVE {draws.sql_placed('SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS x FROM embeddings')} SELECT draw, id AS vec_id FROM draws WHERE draw < 100")
def permuted_sample(spark, d):
    """A seeded draw without replacement by a keyed permutation of the places: no list of them is made."""
    placed = staged(cache.ordinals(_emb(spark, d).select("vec_id"), "vec_id"), "places")
    return draws.sample(placed, "ordinal", placed.count(), 100).select("draw", "vec_id")


@query(f"""WITH {E}, {PAIRS}, {_draws(lambda n: tables.random_pairs(n, 100).T)},
s AS (SELECT gold FROM draws JOIN p ON least(draws.a, draws.b) = p.a AND greatest(draws.a, draws.b) = p.b ORDER BY i LIMIT 100) SELECT {DIST.format('gold')} FROM s""")
def random_pair_scores(spark, d):
    """Scores of the first annotated pairs of a seeded stream of index pairs."""
    emb = _emb(spark, d)
    draws = tables.random_pairs(emb.count(), 100)
    stream = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(draws)], "draw long, a long, b long")
    gold = scored_pairs(emb).select(F.col("a").alias("lo"), F.col("b").alias("hi"), "gold")
    hits = stream.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(gold, ["lo", "hi"])
    return _r(metrics.distribution(hits.orderBy("draw").limit(100), "gold"), 4, *DCOLS)


@query(f"""WITH {U}, {_draws(lambda n: workloads.similarity_draws(n).T)}
SELECT round(avg(list_dot_product(x.v, y.v)), 6) AS self_sim FROM draws JOIN places l ON l.k = draws.a JOIN places r ON r.k = draws.b JOIN u x ON x.vec_id = l.vec_id JOIN u y ON y.vec_id = r.vec_id""")
def self_similarity_seeded(spark, d):
    """Mean cosine of 5,000 seeded pairs of places, but for those of a place with itself."""
    emb = _emb(spark, d)
    return _r(metrics.self_similarity(emb, workloads.similarity_pairs(emb)), 6, "self_sim")


# --- projections


def _w_sql(w):
    return "[" + ", ".join("[" + ", ".join(f"CAST({float(x)!r} AS DOUBLE)" for x in col) + "]" for col in w.T) + "]"


@query(f"""WITH {E}, m AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(range(0, len(v))) AS i, unnest(v) AS x FROM e) GROUP BY i)),
y AS (SELECT vec_id, list_transform({_w_sql(fits.random_matrix(64, 4))}, lambda w: list_dot_product(w, v) - list_dot_product(w, mu)) AS y FROM e, m)
SELECT vec_id, CAST(unnest(range(0, len(y))) AS INT) AS pos, round(unnest(y) / (sqrt(list_dot_product(y, y)) + CAST(1e-12 AS DOUBLE)), 6) AS projected FROM y""")
def random_projection(spark, d):
    emb = _emb(spark, d)
    return _r6(fits.random_projection(emb, 4).transform(emb.select("vec_id", "embedding"), out="projected"))


def _r6(df):
    return _spread(df, "vec_id", "projected", "projected")


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cov FROM range(0, 16) a(i), range(0, 16) b(j)")
def pca_whiten_cov(spark, d):
    """Covariance of whitened vectors before normalisation: the identity, to six places."""
    emb = _emb(spark, d)
    z = fits.pca_white(emb, 16, s=0.0, norm="").transform(emb.select("embedding"))
    return linalg.covariance_frame(z).withColumn("cov", F.round(F.col("cov") + 0.0, 6)).withColumn("cov", F.when(F.col("cov") == 0, 0.0).otherwise(F.col("cov")))


@query("SELECT vec_id, CAST(0 AS DOUBLE) AS residual FROM embeddings")
def abtt_residual(spark, d):
    """What is left along the removed directions: nothing, to six places."""
    import numpy as np

    emb = _emb(spark, d)
    model = fits.abtt(emb)
    gone = np.eye(64) - model.steps[0].w
    z = model.transform(emb.select("vec_id", "embedding"), out="z")
    left = F.array(*[vectors.dot("z", F.array(*[F.lit(float(x)) for x in row])) for row in gone])
    return z.select("vec_id", F.abs(F.round(F.array_max(F.transform(left, lambda x: F.abs(x))), 6)).alias("residual"))


TRACE = f"""WITH {E}, x AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM e), t AS (SELECT var_samp(x) AS s FROM x GROUP BY i)"""


def _component_variances(spark, d, name: str, r: int = 64, **kw):
    """Variances of a projection's components before it normalises, at full dimension."""
    emb = _emb(spark, d)
    model = fits.FITTERS[name](emb, r, **kw)
    model.steps[-1] = replace(model.steps[-1], norm="")
    return np.diag(linalg.covariance(model.transform(emb.select("embedding")))[1])


@query(f"{TRACE} SELECT round(sum(s), 6) AS total FROM t")
def soft_exp_scaling(spark, d):
    """Components divided by the eigenvalue's fourth root have its square root for a variance; their squares add up to the total variance, for no other power."""
    v = _component_variances(spark, d, "soft_exp", s=0.0)
    return spark.createDataFrame([(round(float((v * v).sum()), 6),)], "total double")


@query(f"{TRACE} SELECT round(sum(s), 4) AS total FROM t")
def soft_shrink_scaling(spark, d):
    """A component's variance is its eigenvalue over the shrunk one; solved for the eigenvalues, they add up to the total variance, for no other share."""
    a, v = 0.1, _component_variances(spark, d, "soft_shrink")
    mu, cov = linalg.covariance(_emb(spark, d), "embedding")
    mean = np.trace(cov) / len(mu)
    return spark.createDataFrame([(round(float((v * (a * mean + 1e-8) / (1 - (1 - a) * v)).sum()), 4),)], "total double")


@query("SELECT CAST(i AS INT) AS i, true AS falling FROM range(0, 8) r(i)")
def zca_topr_order(spark, d):
    """The components kept after whitening, each with at least the variance of the next."""
    v = np.append(_component_variances(spark, d, "zca_topr", 8), 0.0)
    return spark.createDataFrame([(i, bool(v[i] >= v[i + 1])) for i in range(8)], "i int, falling boolean")


@query(f"{TRACE} SELECT round(sum(s), 6) AS total FROM t")
def leading_total(spark, d):
    """All eigenvalues as the range finder gives them, which forms no moments of D x D."""
    return spark.createDataFrame([(round(float(directions.leading(_emb(spark, d), 64)[1].sum()), 6),)], "total double")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def npy_round_trip(spark, d):
    """The vectors written to one NumPy file, in order of their ids, and read from it in ranges of rows."""
    path = f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}.npy"
    tables.ensure_dir(spark, shared_folder(spark))
    npy.write_npy(_emb(spark, d), path, order="vec_id")
    return npy.read_npy(spark, path).select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


ONE = "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {1} FROM range(0, {0}) a(i), range(0, {0}) b(j)"


def _square(spark, m, name):
    d = len(m)
    return spark.createDataFrame([(i, j, round(float(m[i, j]), 6) + 0.0) for i in range(d) for j in range(d)], f"i int, j int, {name} double")


def _uncorrelated(name, r=8, **kw):
    """Correlations of a projection's components before normalisation: none, since they are principal directions of what enters the last step."""

    def run(spark, d):
        emb = _emb(spark, d)
        model = fits.FITTERS[name](emb, r, **kw)
        model.steps[-1] = replace(model.steps[-1], norm="")
        c = linalg.covariance(model.transform(emb.select("embedding")))[1]
        s = np.sqrt(np.diag(c))
        return _square(spark, c / np.outer(s, s), "correlation")

    return run


for _fit in ("soft_exp", "soft_shrink", "abtt_pca", "zca_topr"):
    Q[f"{_fit}_correlation"], SQL[f"{_fit}_correlation"] = _uncorrelated(_fit), ONE.format(8, "correlation")


@query(ONE.format(64, "cov"))
def zca_cov(spark, d):
    """Covariance of vectors whitened without shrinking, before normalisation."""
    emb = _emb(spark, d)
    model = fits.zca(emb, s=0.0)
    model.steps[0] = replace(model.steps[0], norm="")
    return _square(spark, linalg.covariance(model.transform(emb.select("embedding")))[1], "cov")


@query(f"""WITH {E}, {KNN}, ed AS (SELECT anchor_id AS a, neighbor_id AS b FROM k UNION SELECT neighbor_id, anchor_id FROM k)
SELECT CAST(count(*) AS BIGINT) AS edges, round(sum(list_dot_product(x.v, x.v)), 4) AS degree_trace, round(sum(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / 2, 4) AS laplace_trace
FROM ed JOIN e x ON x.vec_id = a JOIN e y ON y.vec_id = b""")
def lpp_traces(spark, d):
    """Edges of the neighbour graph, and the traces of the two matrices that the projection is found from."""
    emb = _emb(spark, d)
    edges = staged(knn.symmetric_edges(knn.self_knn(emb, 10)), "edges")
    xdx, xlx = fits._graph_moments(emb, knn.self_knn(emb, 10), "embedding", "vec_id")
    return edges.agg(F.count(F.lit(1)).alias("edges")).select("edges", F.lit(round(float(np.trace(xdx)), 4)).alias("degree_trace"), F.lit(round(float(np.trace(xlx)), 4)).alias("laplace_trace"))


@query(ONE.format(8, "product"))
def lpp_orthonormal(spark, d):
    """W'X'DXW of the generalised projection: its solutions are orthonormal under the degrees."""
    emb = _emb(spark, d)
    w = fits.lpp(emb, 8).steps[0].w
    xdx, _ = fits._graph_moments(emb, knn.self_knn(emb, 10), "embedding", "vec_id")
    return _square(spark, w.T @ xdx @ w, "product")


@query(f"WITH {E}, {X.format('e')} SELECT round(sum(cov), 6) AS variance FROM c WHERE i = j")
def pca_total_variance(spark, d):
    """Variance of all principal directions together, from the condition of an unshrunk soft whitening that undoes nothing."""
    emb = _emb(spark, d)
    model = fits.soft_exp(emb, 64, power=0.0, s=0.0)
    model.steps[0] = replace(model.steps[0], norm="")
    return spark.createDataFrame([(round(float(np.trace(linalg.covariance(model.transform(emb.select("embedding")))[1])), 6),)], "variance double")


def _projection(name, **kw):
    def run(spark, d):
        emb = _emb(spark, d)
        return _r6(fits.FITTERS[name](emb, 16, **kw).transform(emb.select("vec_id", "embedding"), out="projected"))

    return run


Q |= {q: _projection(f) for q, f in (("zca_transform", "zca"), ("pca_whiten", "pca"), ("soft_exp", "soft_exp"), ("soft_shrink", "soft_shrink"), ("abtt", "abtt"), ("abtt_pca", "abtt_pca"), ("zca_topr", "zca_topr"), ("lpp", "lpp"))}
Q["lpp_eigh_of_solve"] = _projection("lpp", mode="eigh_of_solve")


def _learned(protocol, variant="full"):
    def run(spark, d):
        emb = _emb(spark, d)
        return _r6(contrastive(emb, 16, protocol=protocol, variant=variant).transform(emb.select("vec_id", "embedding"), out="projected"))

    return run


Q |= {f"contrastive_{p}": _learned(p) for p in ("annealed", "banked", "ablation")}
Q |= {f"workload_{k}": f for k, f in workloads.WORKLOADS.items()}
