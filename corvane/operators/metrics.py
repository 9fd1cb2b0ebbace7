"""Evaluation as relational plans: rank correlation, retrieval metrics, distributions, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, normalize_added
from ..sources.stage import staged

NAN = float("nan")


#: Rows whose distinct values may be summed up in one task.
FEW = 1 << 16


def cumulative(df: DataFrame, col: str, pieces: int = 256, rows: int | None = None) -> DataFrame:
    """(_v, _n, _upto): each value of col, its number of rows, and the rows up to it.

    Values are counted first and summed inside value ranges on top of the ranges' totals, so neither
    ties nor the whole table meet in one task; a table that is known to have FEW rows at most needs no ranges.
    """
    if rows is not None and rows <= FEW:
        counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        return counts.select("_v", "_n", F.sum("_n").over(Window.orderBy("_v")).alias("_upto"))
    cuts = df.approxQuantile(col, [i / pieces for i in range(1, pieces)], 0.01) if df.schema[col].dataType.simpleString() != "string" else []
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    counts = counts.withColumn("_b", F.size(F.filter(bounds, lambda c: c <= F.col("_v"))))
    per = counts.groupBy("_b").agg(F.sum("_n").alias("_t"))
    per = per.select(F.col("_b").alias("_p"), (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_base"))  # a row a range
    upto = F.sum("_n").over(Window.partitionBy("_b").orderBy("_v"))
    return counts.withColumn("_u", upto).join(per, F.col("_b") == F.col("_p")).select("_v", "_n", (F.col("_base") + F.col("_u")).alias("_upto"))


def average_ranks(df: DataFrame, col: str, out: str, pieces: int = 256) -> DataFrame:
    """df with the rank of col, ties averaged."""
    ranks = cumulative(df, col, pieces).select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(col) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: spearman, times 100; NaN where a side is constant. The pairs are written once, since ranking reads them several times."""
    pairs = staged(df.select(F.col(a).alias("_a"), F.col(b).alias("_b_")).where("_a is not null and _b_ is not null"), "pairs")
    both, n = pairs, pairs.count()
    for c, r in (("_a", "_ra"), ("_b_", "_rb")):
        ranks = cumulative(pairs, c, rows=n).select(F.col("_v").alias(f"{r}v"), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(r))
        both = both.join(ranks, F.col(c) == F.col(f"{r}v"))
    # a constant side has no correlation
    r = F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))
    return both.agg(F.coalesce(r * 100, F.lit(NAN)).alias("spearman"))


def pair_cosines(pairs: DataFrame, emb: DataFrame, key: str = "vec_id", vec: str = "embedding", a: str = "a", b: str = "b") -> DataFrame:
    """pairs with cos, by two look-ups of unit vectors."""
    unit = emb.select(F.col(key).alias("_k"), normalize_added(vec).alias("_v"))
    left = pairs.join(unit.select(F.col("_k").alias(a), F.col("_v").alias("_x")), a)
    return left.join(unit.select(F.col("_k").alias(b), F.col("_v").alias("_y")), b).withColumn("cos", dot("_x", "_y")).drop("_x", "_y")


def retrieval(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per query with a judgment: n_rel, hits, ndcg, recall, precision, of ranked (anchor_id, neighbor_id, rank) against qrels (query_id, corpus_id)."""
    rel = qrels.select("query_id", "corpus_id").distinct()
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hit = ranked.where(F.col("rank") <= k).join(rel, (F.col("anchor_id") == F.col("query_id")) & (F.col("neighbor_id") == F.col("corpus_id")))
    return _retrieval(n, hit, k)


def label_partners(queries: DataFrame, corpus: DataFrame, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """(query_id, l, n_rel): how many others of corpus share a query's label, from counts by label; queries without any are left out."""
    counts = corpus.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("_n"))
    own = queries.select(F.col(id_col).alias("query_id"), F.col(label).alias("l"))
    mine = corpus.select(F.col(id_col).alias("query_id"), F.lit(1).alias("_own"))
    n = own.join(counts, "l").join(mine, "query_id", "left").withColumn("n_rel", F.col("_n") - F.coalesce("_own", F.lit(0)))
    return n.where("n_rel > 0").select("query_id", "l", "n_rel")


def label_hits(ranked: DataFrame, partners: DataFrame, corpus: DataFrame, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """ranked (anchor_id, neighbor_id, ...) of the queries with partners, with query_id and hit: whether the neighbour is another vector of the query's label."""
    seen = ranked.join(partners.select("query_id", "l"), F.col("anchor_id") == F.col("query_id"))
    seen = seen.join(corpus.select(F.col(id_col).alias("neighbor_id"), F.col(label).alias("_l")), "neighbor_id", "left")
    return seen.withColumn("hit", (F.col("_l") == F.col("l")) & (F.col("neighbor_id") != F.col("anchor_id"))).drop("l", "_l")


def label_retrieval(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 10, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """As retrieval, where all other vectors of a query's label are relevant; relevant pairs are never made."""
    partners = label_partners(queries, corpus, id_col, label)
    hit = label_hits(ranked.where(F.col("rank") <= k), partners, corpus, id_col, label).where("hit")
    return _retrieval(partners.select("query_id", "n_rel"), hit, k)


def _retrieval(n: DataFrame, hit: DataFrame, k: int) -> DataFrame:
    gain = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    top = F.least(F.col("n_rel"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), top), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return n.join(gain, "query_id", "left").select(
        "query_id", "n_rel", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        (F.coalesce("hits", F.lit(0)) / top).alias("recall"), (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"),
    )


def retrieval_means(per_query: DataFrame) -> DataFrame:
    """One row: ndcg and recall times 100, precision, hit_rate, n; NaN without queries."""
    m = lambda c: F.coalesce(F.avg(c), F.lit(NAN))
    return per_query.agg((m("ndcg") * 100).alias("ndcg"), (m("recall") * 100).alias("recall"), m("precision").alias("precision"), m((F.col("hits") > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def gold_partners(pairs: DataFrame, threshold: float, a: str = "a", b: str = "b", score: str = "gold") -> DataFrame:
    """(anchor, partner) in both directions, of pairs that reach the threshold."""
    p = pairs.where(F.col(score) >= threshold).select(F.col(a).alias("anchor"), F.col(b).alias("partner"))
    return p.union(p.select("partner", "anchor")).distinct()


def mined_precision(knn: DataFrame, partners: DataFrame, k: int, tau: float) -> DataFrame:
    """One row: precision over what was mined, recall over min(partners, k), hit_rate, n; anchors without partners or mined neighbours are left out."""
    mined = knn.where((F.col("rank") <= k) & (F.col("sim") >= tau))
    n = partners.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_gold"))
    flags = mined.join(partners.withColumn("hit", F.lit(1)), (F.col("anchor_id") == F.col("anchor")) & (F.col("neighbor_id") == F.col("partner")), "left").drop("anchor", "partner")
    per = flags.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("mined"), F.count("hit").alias("h")).join(n, F.col("anchor_id") == F.col("anchor"))
    m = lambda c: F.coalesce(F.avg(c), F.lit(NAN))
    return per.agg(m(F.col("h") / F.col("mined")).alias("precision"), m(F.col("h") / F.least("n_gold", F.lit(k))).alias("recall"), m((F.col("h") > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def label_precision(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """As mined_precision without a threshold, where all other vectors of a query's label are partners."""
    partners = label_partners(queries, corpus, id_col, label)
    flags = label_hits(ranked.where(F.col("rank") <= k), partners, corpus, id_col, label)
    per = flags.groupBy("query_id").agg(F.count(F.lit(1)).alias("mined"), F.count(F.when(F.col("hit"), 1)).alias("h")).join(partners, "query_id")
    m = lambda c: F.coalesce(F.avg(c), F.lit(NAN))
    return per.agg(m(F.col("h") / F.col("mined")).alias("precision"), m(F.col("h") / F.least("n_rel", F.lit(k))).alias("recall"), m((F.col("h") > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def last_wins(pairs: DataFrame, a: str, b: str, score: str, order: str) -> DataFrame:
    """(lo, hi, score): one row per unordered pair, the latest judgment."""
    return pairs.groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.max_by(score, order).alias("score"))


def mined_scores(knn: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold scores (lo, hi, score) of neighbour pairs, from both ends."""
    return knn.select("anchor_id", "neighbor_id", F.least("anchor_id", "neighbor_id").alias("lo"), F.greatest("anchor_id", "neighbor_id").alias("hi")).join(gold, ["lo", "hi"])


def distribution(df: DataFrame, col: str) -> DataFrame:
    """One row: mean, median, p25, p75 (between neighbouring values in proportion), shares of at least 4 and 4.5, n.

    The quantiles are read off the running counts of the distinct values, which stay spread over tasks.
    """
    x = staged(df.select(F.col(col).cast("double").alias("x")).where("x is not null"), "values")
    nan = lambda c: F.coalesce(c, F.lit(NAN))
    n = x.count()

    def quantile(q: float):
        at = q * max(n - 1, 0)
        low = int(at)
        # the values at (zero-based) places low and low + 1
        value = [F.max(F.when((F.col("_upto") - F.col("_n") <= k) & (F.col("_upto") > k), F.col("_v"))) for k in (low, min(low + 1, max(n - 1, 0)))]
        return nan(value[0] + (value[1] - value[0]) * (at - low))

    spread = cumulative(x, "x", rows=n).agg(quantile(0.5).alias("median"), quantile(0.25).alias("p25"), quantile(0.75).alias("p75"))
    share = lambda t: nan(F.avg((F.col("x") >= t).cast("double")) * 100)
    means = x.agg(nan(F.avg("x")).alias("mean"), share(4.0).alias("pct_ge_4_0"), share(4.5).alias("pct_ge_4_5"), F.count("x").alias("n"))
    return means.crossJoin(spread).select("mean", "median", "p25", "p75", "pct_ge_4_0", "pct_ge_4_5", "n")  # one row each


def anisotropy(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: mean cosine of the rows with their mean direction; the closed form |mean of unit rows|."""
    unit = df.where(F.col(vec).isNotNull()).select(F.posexplode(normalize_added(vec)).alias("pos", "x"))
    return unit.groupBy("pos").agg(F.avg("x").alias("m")).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("anisotropy_mean"))


def self_similarity(df: DataFrame, pairs: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    return pair_cosines(pairs.where(F.col("a") != F.col("b")), df, key, vec).agg(F.coalesce(F.avg("cos"), F.lit(NAN)).alias("self_sim"))


def geometry(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: anisotropy_mean, offdiag_cov (mean absolute off-diagonal covariance over all cells), avg_feature_std (population)."""
    import numpy as np

    from .linalg import central, moments

    unit = df.where(F.col(vec).isNotNull()).select(normalize_added(vec).alias(vec))
    n, *sums = moments(unit, vec)
    mu, cov = central(n, *sums)
    r = len(mu)
    off = float(np.abs(cov - np.diag(np.diag(cov))).sum() / (r * r)) if r else NAN
    std = float(np.sqrt(np.diag(cov) * (n - 1) / n).mean()) if r else NAN
    return df.sparkSession.createDataFrame([(float(np.linalg.norm(mu)), off, std)], "anisotropy_mean double, offdiag_cov double, avg_feature_std double")


def seed_summary(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation over seeds."""
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))


def complete_average(results: DataFrame, by: list[str], dataset: str, value: str, need: int) -> DataFrame:
    """Averages of groups in which all data sets are present; a null in by is a group of its own."""
    return results.groupBy(*by).agg(F.avg(value).alias("average"), F.countDistinct(dataset).alias("n")).where(F.col("n") == need)


def gap_to(results: DataFrame, by: list[str], method: str, base: str, value: str, std: str, floor: float = 0.2) -> DataFrame:
    """Gap of every method to the base method at the same settings, and whether it exceeds both deviations and the floor."""
    ref = results.where(F.col(method) == base).select(*by, F.col(value).alias("_b"), F.col(std).alias("_s"))
    out = results.where(F.col(method) != base).join(ref, by)
    gap = F.col(value) - F.col("_b")
    return out.select(*by, method, value, gap.alias("gap"), (gap > F.greatest(F.coalesce(F.col("_s"), F.lit(0.0)), F.coalesce(F.col(std), F.lit(0.0)), F.lit(floor))).alias("clear"))


def transfer(results: DataFrame, by: list[str], mode: str, value: str) -> DataFrame:
    """Transfer against refit and base: drop_vs_refit, still_above_base."""
    one = lambda m: F.max(F.when(F.col(mode) == m, F.col(value)))
    wide = results.groupBy(*by).agg(one("base").alias("base"), one("refit").alias("refit"), one("transfer").alias("transfer"))
    return wide.select(*by, "transfer", (F.col("refit") - F.col("transfer")).alias("drop_vs_refit"), (F.col("transfer") > F.col("base")).alias("still_above_base"))


def wide_table(results: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    return results.groupBy(row).pivot(column, values).agg(F.round(F.first(value), 2))


def best_by(results: DataFrame, by: list[str], value: str, order: str, pick: str) -> DataFrame:
    """The entry of the highest value in each group, the first on ties."""
    return results.groupBy(*by).agg(F.max_by(pick, F.struct(F.col(value), -F.col(order))).alias(pick), F.max(value).alias(value))


def vectors_close(a, b, eps: float = 1e-9):
    return F.abs(dot(doubles(a), doubles(b)) - 1) < eps
