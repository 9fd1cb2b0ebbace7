"""Evaluation workloads: which projections are fitted to what, and how each is scored.

Stand-ins for external data: pairs are vectors 2i and 2i + 1, scored by how near their labels are;
queries are the vectors whose id is divisible by 100, searched against all vectors; a vector of the
same label is relevant, the query itself is not. Where encoders are compared (prompts, poolings, layers, echo), the
vectors are encoded from the documents: pairs are documents 2i and 2i + 1, scored by their words in common, and a
document of the same language and source is relevant.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..operators import metrics
from ..operators.fits import FITTERS, condition_number
from ..operators.grid import Job, fit_grid
from ..operators.knn import self_knn, topk_join
from ..sources import cache
from ..sources.encoders import Encoder
from ..sources.stage import staged
from ..sources.tables import table

#: Seeds of the protocols of the main tables, and of those of the later ones.
SEEDS = (42, 43, 44)
LATER = (0, 1, 2)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def scored_pairs(emb: DataFrame) -> DataFrame:
    """(a, b, gold) of vectors 2i and 2i + 1."""
    p = emb.groupBy(F.floor(F.col("vec_id") / 2).alias("i")).agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b"), F.min("label").alias("l1"), F.max("label").alias("l2"))
    return p.where("a < b").select("a", "b", (F.lit(5.0) - F.abs(F.col("l1") - F.col("l2")) * 5.0 / 9.0).alias("gold"))


def similarity_draws(n: int, size: int = 5000, seed: int = 42):
    """Places of the pairs that self-similarity is averaged over."""
    rng = np.random.RandomState(seed)
    i, j = rng.randint(0, n, size), rng.randint(0, n, size)
    return np.stack([i, j], axis=1)[i != j]


def similarity_pairs(emb: DataFrame) -> DataFrame:
    """(a, b): ids at the drawn places."""
    at = staged(cache.ordinals(emb.select("vec_id"), "vec_id"), "places")
    draws = emb.sparkSession.createDataFrame([(int(i), int(j)) for i, j in similarity_draws(at.count())], "i long, j long")
    side = lambda i, x: at.select(F.col("ordinal").alias(i), F.col("vec_id").alias(x))
    return F.broadcast(draws).join(side("i", "a"), "i").join(side("j", "b"), "j").select("a", "b")


def queries_of(emb: DataFrame) -> DataFrame:
    return emb.where(F.col("vec_id") % 100 == 0)


def label_qrels(emb: DataFrame) -> DataFrame:
    q = queries_of(emb).select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    return q.join(emb.select(F.col("vec_id").alias("corpus_id"), "label"), F.col("l") == F.col("label")).where("query_id <> corpus_id").select("query_id", "corpus_id")


def fit_all(samples: dict[str, DataFrame], wants) -> list:
    """Projections of wants, (sample, method, rank, seed, settings): a closed form by name, or contrastive with a protocol and a variant ('contrastive:banked:no_qr') and single settings of the protocol. All learned ones are one grid of tasks; closed forms are fitted once each."""
    jobs, known = {}, {}
    for i, (sample, method, r, seed, over) in enumerate(wants):
        name, *more = method.split(":")
        if name == "contrastive":
            jobs[i] = Job(sample, r, more[0] if more else "annealed", more[1] if len(more) > 1 else "full", seed, tuple(sorted(over.items())))
    learned = fit_grid(samples, list(jobs.values()))
    for i, (sample, method, r, _, _) in enumerate(wants):
        if i not in jobs and (sample, method, r) not in known:
            known[sample, method, r] = FITTERS[method](samples[sample], r or 0)
    return [learned[jobs[i]] if i in jobs else known[w[:3]] for i, w in enumerate(wants)]


def fitted(method: str, emb: DataFrame, r: int, seed: int = 42, **over):
    """One projection, see ``fit_all``."""
    return fit_all({"all": emb}, [("all", method, r, seed, over)])[0]


def _row(df: DataFrame, method: str, r: int | None, metric: str, value: str, seed: int | None = None, **more) -> DataFrame:
    cols = [F.lit(method).alias("method"), F.lit(r).cast("int").alias("r"), F.lit(seed).cast("int").alias("seed"), F.lit(metric).alias("metric_name"), F.bround(value, 4).alias("metric_value")]
    return df.select(*cols, *[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in more.items()])


def _all(rows: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def correlation(emb: DataFrame, model, pairs: DataFrame | None = None) -> DataFrame:
    z = model.transform(emb.select("vec_id", "embedding"))
    return metrics.spearman(metrics.pair_cosines(scored_pairs(emb) if pairs is None else pairs, z), "gold", "cos")


def search(emb: DataFrame, model, k: int = 10) -> DataFrame:
    z = staged(model.transform(emb), "projected")  # read by both sides of the search, and counted
    return metrics.retrieval_means(metrics.label_retrieval(topk_join(queries_of(z), z, k), queries_of(emb), emb, k))


def _fits(samples: dict[str, DataFrame], methods, dims, seeds) -> list[tuple]:
    """(sample, method, dimension, seed, model) of a table's rows. Full-dimensional methods are fitted once; learned ones alone take several seeds."""
    wants = [(x, m, r, s, {}) for x in samples for m in methods for r in (dims if m not in ("base", "zca", "abtt") else [None]) for s in (seeds if m.startswith("contrastive") else [None])]
    return [(*w[:4], f) for w, f in zip(wants, fit_all(samples, wants), strict=True)]


def _table(score, samples: dict[str, DataFrame], methods, dims, seeds, metric: str, value: str, tag: str | None = None, **more) -> DataFrame:
    """One row per sample, method, dimension and seed; tag names the column of the sample."""
    rows = [_row(score(x, f), m, r, metric, value, s, **more, **({tag: x} if tag else {})) for x, m, r, s, f in _fits(samples, methods, dims, seeds)]
    return _all(rows)


def correlation_table(emb: DataFrame | dict[str, DataFrame], methods, dims, seeds=SEEDS, pairs: DataFrame | None = None, tag: str | None = None) -> DataFrame:
    """One row per method, dimension and seed, of one table of vectors or of several by name."""
    samples = emb if isinstance(emb, dict) else {"all": emb}
    return _table(lambda x, f: correlation(samples[x], f, pairs), samples, methods, dims, seeds, "spearman", "spearman", tag)


def search_table(emb: DataFrame | dict[str, DataFrame], methods, dims, seeds=SEEDS, tag: str | None = None) -> DataFrame:
    samples = emb if isinstance(emb, dict) else {"all": emb}
    return _table(lambda x, f: search(samples[x], f), samples, methods, dims, seeds, "ndcg10", "ndcg", tag, recall_at_10=F.bround("recall", 4))


# --- encoded documents


def document_pairs(spark, sf_dir) -> DataFrame:
    """(a, b, gold) of documents 2i and 2i + 1: five times their words in common."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select("doc_id", "text")
    return d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("a"), F.col("text").alias("x")).join(d.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("y")), "a").select("a", "b", (jaccard("x", "y") * 5).alias("gold"))


def encoded(spark, sf_dir, encoder: Encoder) -> DataFrame:
    """(vec_id, embedding, label) of the documents."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("vec_id"), "text", F.concat_ws("/", "lang", "source").alias("label"))
    cores = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < cores:  # a few files
        d = d.repartition(cores)
    return staged(encoder.encode(d, keep=("vec_id", "label")).where("embedding is not null").select("vec_id", "embedding", "label"), "encoded")


#: Sources of the prompt and echo tables, by name.
PROMPTS = {
    "mean_pool": Encoder(), "PromptEOL_A": Encoder(template="PromptEOL_A", pool="last"), "PromptEOL_B": Encoder(template="PromptEOL_B", pool="last"),
    "Echo_mean": Encoder(template="Echo"), "Echo_last": Encoder(template="Echo", pool="last"),
}
POOLINGS = {"mean": Encoder(), "last": Encoder(pool="last")}
#: Layers of the layer table, in the protocol's order, which decides ties: a third, half, all but one, all of 28.
LAYERS = {"early_middle": 9, "middle": 14, "second_last": 27, "last": 28}


def sts_testonly(spark, sf_dir, methods=("base", "pca", "soft_exp", "zca_topr", "contrastive:banked"), dims=(8, 16), seeds=SEEDS):
    return correlation_table(vectors(spark, sf_dir), methods, dims, seeds)


def sts_baselines(spark, sf_dir, methods=("base", "abtt", "lpp", "random", "abtt_pca", "soft_shrink"), dims=(16,), seeds=SEEDS):
    return correlation_table(vectors(spark, sf_dir), methods, dims, seeds)


def abtt_table(spark, sf_dir, methods=("base", "abtt", "pca", "abtt_pca", "zca", "contrastive:annealed"), dims=(16,), seeds=SEEDS):
    emb = vectors(spark, sf_dir)
    rows = [(m, r, s, correlation(emb, f), search(emb, f)) for _, m, r, s, f in _fits({"all": emb}, methods, dims, seeds)]
    return _all([x for m, r, s, c, n in rows for x in (_row(c, m, r, "spearman", "spearman", s), _row(n, m, r, "ndcg10", "ndcg", s, recall_at_10=F.bround("recall", 4)))])


def quora_main(spark, sf_dir, methods=("base", "pca", "soft_exp", "zca_topr", "random", "lpp", "contrastive:annealed"), dims=(16,), seeds=SEEDS):
    return search_table(vectors(spark, sf_dir), methods, dims, seeds)


def cqadupstack(spark, sf_dir, methods=("base", "abtt", "zca", "pca", "abtt_pca", "contrastive:annealed"), dims=(16,), seeds=SEEDS):
    """Three sub-collections (labels 0 to 2, 3 to 5, and the others) and averages over complete groups."""
    emb = vectors(spark, sf_dir)
    sets = {"low": "label < 3", "middle": "label between 3 and 5", "high": "label > 5"}
    every = staged(search_table({n: emb.where(c) for n, c in sets.items()}, methods, dims, seeds, "dataset"), "cqa")
    mean = metrics.complete_average(every, ["method", "r", "metric_name"], "dataset", "metric_value", len(sets))
    return every.select("dataset", "method", "r", "seed", "metric_value").unionByName(mean.select(F.lit("average").alias("dataset"), "method", "r", F.lit(None).cast("int").alias("seed"), F.round("average", 4).alias("metric_value")))


def sts_suite(spark, sf_dir, methods=("base", "abtt", "zca", "pca", "random", "contrastive:annealed"), dims=(16,), seeds=LATER):
    """Six sub-collections by label, and averages over complete groups."""
    emb = vectors(spark, sf_dir)
    sets = {f"set{i}": emb.where(F.floor(F.col("vec_id") / 2) % 6 == i) for i in range(6)}
    every = staged(correlation_table(sets, methods, dims, seeds, tag="dataset"), "suite")
    mean = metrics.complete_average(every, ["method", "r"], "dataset", "metric_value", len(sets))
    return every.select("dataset", "method", "r", "seed", "metric_value").unionByName(mean.select(F.lit("average").alias("dataset"), "method", "r", F.lit(None).cast("int").alias("seed"), F.round("average", 4).alias("metric_value")))


def prompt_sources(spark, sf_dir, methods=("base", "contrastive:annealed"), dims=(8,), seeds=LATER):
    """Correlation of every source of vectors; the plain one alone is searched as well, as in the protocol."""
    pairs = staged(document_pairs(spark, sf_dir), "pairs")
    sources = {name: encoded(spark, sf_dir, e) for name, e in PROMPTS.items()}
    fits = _fits(sources, methods, dims, seeds)
    rows = [_row(correlation(sources[x], f, pairs), m, r, "spearman", "spearman", s, embedding_type=x) for x, m, r, s, f in fits]
    plain = [_row(search(sources[x], f), m, r, "ndcg10", "ndcg", s, recall_at_10=F.bround("recall", 4), embedding_type=x) for x, m, r, s, f in fits if x == "mean_pool"]
    return _all(rows + plain)


def pooling_variants(spark, sf_dir, methods=("base", "pca", "zca", "contrastive:annealed"), dims=(8,), seeds=LATER):
    pairs = staged(document_pairs(spark, sf_dir), "pairs")
    return correlation_table({p: encoded(spark, sf_dir, e) for p, e in POOLINGS.items()}, methods, dims, seeds, pairs, "pooling")


def layer_selection(spark, sf_dir, methods=("contrastive:annealed",), dims=(8,), seeds=LATER):
    """Base scores of four layers under two poolings, the best of them (first on ties), and the learned projection on the reference (last layer, mean), the second-last and the best."""
    pairs = staged(document_pairs(spark, sf_dir), "pairs")
    at = [(name, pool) for name in LAYERS for pool in POOLINGS]
    emb = {x: encoded(spark, sf_dir, replace(POOLINGS[x[1]], layer=LAYERS[x[0]])) for x in at}
    tag = lambda df, name, pool: df.withColumns({"layer_name": F.lit(name), "layer_idx": F.lit(LAYERS[name]), "pooling": F.lit(pool)})
    base = staged(_all([tag(correlation_table(emb[x], ["base"], [], pairs=pairs), *x) for x in at]), "layers")
    value = {(row["layer_name"], row["pooling"]): row["metric_value"] for row in base.collect()}  # eight rows
    best = max(at, key=lambda x: value[x])
    picked = list(dict.fromkeys([("last", "mean"), ("second_last", "mean"), best]))
    learned = _all([tag(_row(correlation(emb[x], f, pairs), m, r, "spearman", "spearman", s), *x) for x, m, r, s, f in _fits({x: emb[x] for x in picked}, methods, dims, seeds)])
    top = base.where((F.col("layer_name") == best[0]) & (F.col("pooling") == best[1])).withColumn("method", F.lit("best"))
    return _all([base, top, learned]).select("method", "layer_name", "layer_idx", "pooling", "r", "seed", "metric_value")


def echo_whitening(spark, sf_dir, methods=("base", "zca", "pca", "zca_topr", "contrastive:annealed"), dims=(8,), seeds=LATER):
    """Projections of the echo source."""
    return correlation_table(encoded(spark, sf_dir, PROMPTS["Echo_mean"]), methods, dims, seeds, staged(document_pairs(spark, sf_dir), "pairs")).withColumn("embedding_type", F.lit("Echo_mean"))


def cross_dataset(spark, sf_dir, methods=("pca", "contrastive:annealed"), dims=(16,), seeds=LATER):
    """Transfer against refit and base, by the mean over seeds; each model is trained once.

    Pairs to pairs: fitted on labels below 5, tested on the others. Across tasks, the pairs of labels below 5 (sts) and
    the search among the others (search) stand for the two tasks, and the searches among labels 0-2 and 3-4 for sub-collections.
    """
    emb = vectors(spark, sf_dir)
    sets = {"sts": emb.where("label < 5"), "search": emb.where("label >= 5"), "cqa-low": emb.where("label < 3"), "cqa-high": emb.where("label in (3, 4)")}
    tests = [("sts", "search", "spearman"), ("sts", "search", "ndcg10"), ("search", "sts", "spearman"), ("search", "cqa-low", "ndcg10"), ("search", "cqa-high", "ndcg10")]
    fits = _fits(sets, methods, dims, seeds)
    model = {(x, m, r, s): f for x, m, r, s, f in fits}
    base = dict(zip(sets, fit_all(sets, [(x, "base", None, None, {}) for x in sets]), strict=True))
    rows = []
    for m, r, s in dict.fromkeys(f[1:4] for f in fits):
        for train, test, metric in tests:
            score, value = (correlation, "spearman") if metric == "spearman" else (search, "ndcg")
            modes = {"transfer": model[train, m, r, s], "refit": model[test, m, r, s]} | ({"base": base[test]} if s in (None, seeds[0]) else {})
            rows += [_row(score(sets[test], f), m, r, metric, value, None if mode == "base" else s, fit_mode=mode, train_dataset=train, test_dataset=test) for mode, f in modes.items()]
    by = ["method", "r", "train_dataset", "test_dataset", "metric_name"]
    return metrics.transfer(metrics.seed_summary(_all(rows), [*by, "fit_mode"], "metric_value"), by, "fit_mode", "mean")


#: How positives are found, by name: settings of the protocol.
POSITIVES = {"random": {"positives": "random"}, "noise": {"positives": "noise"}, "knn1": {"k": 1}, "knn5": {"k": 5}, "knn10": {"k": 10}, "knn40": {"k": 40}}


def positive_search(spark, sf_dir, methods=tuple(POSITIVES), dims=(16,), seeds=LATER):
    """Search by the way that positives are found, and the gap to random ones."""
    emb = vectors(spark, sf_dir)
    wants = [(name, r, s) for name in dict.fromkeys(("random", *methods)) for r in dims for s in seeds]
    fits = fit_all({"all": emb}, [("all", "contrastive:annealed", r, s, POSITIVES[name]) for name, r, s in wants])
    per = _all([_row(search(emb, f), name, r, "ndcg10", "ndcg", s) for (name, r, s), f in zip(wants, fits, strict=True)])
    return metrics.gap_to(metrics.seed_summary(per, ["method", "r"], "metric_value"), ["r"], "method", "random", "mean", "std")


#: Spaces that neighbours are mined in, by name.
SPACES = {"raw": "base", "zca": "zca", "contrastive": "contrastive:annealed"}


def spaces(emb: DataFrame, methods=tuple(SPACES), dims=(16,), seeds=SEEDS[:1]) -> dict:
    """Projection by the name of its space; a space with several dimensions or seeds is named by them."""
    fits = _fits({"all": emb}, [SPACES.get(m, m) for m in methods], dims, seeds)
    names = {v: k for k, v in SPACES.items()}
    many = len(dims) > 1 or len(seeds) > 1
    return {":".join([names.get(m, m), *(str(v) for v in (r, s) if many and v is not None)]): f for _, m, r, s, f in fits}


def mined_precision(spark, sf_dir, methods=tuple(SPACES), dims=(16,), seeds=SEEDS[:1]):
    """Neighbours among the pairs' own vectors against gold partners, and of the queries among all vectors against judgments."""
    emb = vectors(spark, sf_dir)
    gold = metrics.gold_partners(scored_pairs(emb), 4.0)
    rows = []
    for s, m in spaces(emb, methods, dims, seeds).items():
        z = staged(m.transform(emb), "projected")
        mined = metrics.mined_precision(self_knn(z, 10), gold, 10, 0.0)
        searched = metrics.label_precision(topk_join(queries_of(z), z, 10), queries_of(emb), emb, 10)
        for name, found in (("sts", mined), ("search", searched)):
            rows.append(found.select(F.lit(name).alias("dataset"), F.lit(s).alias("space"), *[F.round(c, 4).alias(c) for c in ("precision", "recall", "hit_rate")], "n"))
    return _all(rows)


def neighbor_scores(spark, sf_dir, methods=tuple(SPACES), dims=(16,), seeds=SEEDS[:1]):
    emb = vectors(spark, sf_dir)
    gold = metrics.last_wins(scored_pairs(emb).withColumn("ord", F.col("a")), "a", "b", "gold", "ord")
    return _all([metrics.distribution(metrics.mined_scores(self_knn(m.transform(emb), 40), gold), "score").select(F.lit(s).alias("space"), "*") for s, m in spaces(emb, methods, dims, seeds).items()])


def regularizer_audit(spark, sf_dir, methods=("full", "no_cov", "no_orth", "no_both", "no_hardneg", "no_qr", "no_refinement"), dims=(16,), seeds=SEEDS):
    """Correlation with diagnostics, and search, of each variant and seed; methods are variants of the annealed protocol."""
    emb, rows = vectors(spark, sf_dir), []
    for _, name, r, s, model in _fits({"all": emb}, [f"contrastive:annealed:{v}" for v in methods], dims, seeds):
        v = name.rpartition(":")[2]
        cond = F.lit(round(condition_number(model), 4))
        sts = correlation(emb, model).crossJoin(metrics.geometry(model.transform(emb)))
        rows.append(_row(sts, v, r, "spearman", "spearman", s, cond_number=cond, **{c: F.round(c, 6) for c in ("offdiag_cov", "avg_feature_std", "anisotropy_mean")}))
        rows.append(_row(search(emb, model), v, r, "ndcg10", "ndcg", s, cond_number=cond))
    return _all(rows)


def anisotropy_table(spark, sf_dir, methods=("base", "contrastive:annealed"), dims=(8, 16), seeds=SEEDS[:1]):
    emb = vectors(spark, sf_dir)
    pairs, rows = staged(similarity_pairs(emb), "pairs"), []
    for _, m, r, s, model in _fits({"all": emb}, methods, dims, seeds):
        z = model.transform(emb)
        seed = {"seed": F.lit(s).cast("int")} if len(seeds) > 1 else {}
        row = metrics.anisotropy(z).crossJoin(metrics.self_similarity(z, pairs))
        rows.append(row.select(F.lit(m.partition(":")[0]).alias("method"), F.lit(r or model.steps[-1].w.shape[1]).alias("dim"), *[v.alias(k) for k, v in seed.items()], F.round("anisotropy_mean", 6).alias("anisotropy_mean"), F.round("self_sim", 6).alias("self_sim")))
    return _all(rows)


def component_ablation(spark, sf_dir, dims=(8, 16), seeds=SEEDS[:1]):
    """The protocol's twelve variants, under its one seed; banked is the one with retraction and without refinement."""
    learned = ["ablation:random_pairs", "ablation:bank_no_hardneg", "ablation:hardneg_no_bank", "ablation", "ablation:no_refinement", "banked", "ablation:full_qr"]
    methods = ["pca", "soft_exp", "random", "lpp", "zca_topr", *[f"contrastive:{x}" for x in learned]]
    return metrics.wide_table(correlation_table(vectors(spark, sf_dir), methods, dims, seeds), "method", "r", list(dims), "metric_value")


WORKLOADS = {
    "sts_testonly": sts_testonly, "sts_baselines": sts_baselines, "abtt_table": abtt_table, "quora_main": quora_main, "cqadupstack": cqadupstack, "sts_suite": sts_suite,
    "prompt_sources": prompt_sources, "pooling_variants": pooling_variants, "layer_selection": layer_selection, "echo_whitening": echo_whitening, "cross_dataset": cross_dataset,
    "positive_search": positive_search, "mined_precision_spaces": mined_precision, "neighbor_scores_spaces": neighbor_scores, "regularizer_audit": regularizer_audit,
    "anisotropy_table": anisotropy_table, "component_ablation": component_ablation,
}
