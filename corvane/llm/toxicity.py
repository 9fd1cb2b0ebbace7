"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a hashed word vector plus the scaled sum of its hashed character n-gram vectors. Two
gated recurrent layers read a window of words from either end, attention pools their states, and a
logistic unit scores the window. Windows of ``WIDTH`` words begin every ``STRIDE`` words, so every
word is read in two contexts; a text's score is its highest window's.

The network is fitted on the driver to at most ``SAMPLE`` labelled documents (of which texts above ``LONGEST`` bytes are left out), half of them toxic if
there are as many, drawn by a digest of the id. In the first epochs all windows of a toxic
document count as toxic, later those that the network already finds so; the first epochs read two
clean windows, drawn anew, for each toxic one, the later ones all. The output is set back from the odds
of the sample to those of the labels, and then, as the highest of many windows errs upwards, by the shift that makes least errors on
all labelled documents, where a toxic one missed counts ``MISSED`` times; these are scored on Spark, and counted by label and step of the shift.
Documents are scored where they are read, so no text is shuffled: only ids and scores meet the labels. Scoring computes the
input products once per distinct word of a batch and covers all windows of all texts.

Defined results: a null or wordless text is read as one empty window and gets the score of no
evidence; null labels teach nothing; without any labelled row the score is 0; repeated rows give
repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .langid import held_out
from .tokens import Words, ngrams, slices, word_hash

SAMPLE = 3000
#: Bytes of the longest text that the fit reads, so that the driver holds at most SAMPLE times as many.
LONGEST = 1 << 17
#: Weight of a toxic document that is missed, when the output is shifted, and the shifts that are tried.
MISSED = 2
SHIFTS = np.arange(0, 4.01, 0.25)
#: Texts of the sample that a word must be in to get a vector of its own; rarer words are read by their characters.
USUAL = 4
WIDTH = 64
STRIDE = 48
DIM = 12
HIDDEN = 8
ATTEND = 8
WORDS = 1 << 17
GRAMS = 1 << 16
#: Byte lengths of a word's character n-grams, with a mark at both ends.
SIZES = (3, 5)
EPOCHS = 5
#: Epochs in which all windows of a toxic document count as toxic.
NOISY = 3
#: Steps that the epochs of either kind take at least; small samples are read more often.
STEPS = 200
BATCH = 128
RATE = 0.01
SEED = 7


def windows(at: np.ndarray, width: int = WIDTH, stride: int = STRIDE):
    """(first word, number of words, text) of all overlapping windows; a wordless text has one empty window."""
    size = np.diff(at)
    n = np.maximum(1, -(-(size - width) // stride) + 1)
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = at[:-1][text] + k * stride
    return begin, np.minimum(size[text] - k * stride, width), text


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class Net:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = lambda *s, scale=1.0: (r.normal(size=s) * scale).astype(np.float32)
        self.p = {"ew": np.zeros((WORDS, DIM), np.float32), "ec": f(GRAMS, DIM, scale=0.2), "a": f(2 * HIDDEN, ATTEND, scale=0.7), "v": f(ATTEND, scale=0.7), "o": f(2 * HIDDEN, scale=0.7), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {"w" + d: f(DIM, 3 * HIDDEN, scale=0.5), "u" + d: f(HIDDEN, 3 * HIDDEN, scale=0.3), "k" + d: np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, w: Words):
        """Vectors of a batch's distinct words, and the buckets they came from."""
        data, off = w.bytes()
        h = word_hash(data, off, WORDS)
        owner, gram = ngrams(data, off, SIZES, GRAMS)
        order = np.argsort(owner, kind="stable")
        owner, gram = owner[order], gram[order]
        n = np.sqrt(np.maximum(np.bincount(owner, minlength=len(w.words)), 1)).astype(np.float32)
        x = self.p["ew"][h].copy()
        for j in range(DIM):
            x[:, j] += np.bincount(owner, weights=self.p["ec"][gram, j], minlength=len(x)) / n
        return x, (h, owner, gram, n)

    def forward(self, x, codes, begin, size, keep=False):
        """Probability of each window; with keep, all that the backward pass needs."""
        p, m, width = self.p, len(begin), int(size.max()) if len(size) else 0
        width = max(width, 1)
        if not len(x):
            x, codes = np.zeros((1, DIM), np.float32), np.zeros(1, np.int64)
        states = np.zeros((width, m, 2 * HIDDEN), np.float32)
        memo = {}
        whole = bool((size == width).all())
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            gx = x @ p["w" + d] + p["k" + d]
            u = p["u" + d]
            h = np.zeros((m, HIDDEN), np.float32)
            for s in range(width):
                t = s if d == "f" else width - 1 - s
                g = np.take(gx, codes[np.minimum(begin + t, len(codes) - 1)], axis=0)
                gh = h @ u
                rz = _sigmoid(g[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                n = np.tanh(g[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
                new = n + z * (h - n)
                if not whole:
                    new = np.where((t < size)[:, None], new, h)
                if keep:
                    memo[d, t] = (h, r, z, n, gh[:, 2 * HIDDEN :])
                h = new
                states[t, :, part] = h
        e = np.tanh(states.reshape(-1, 2 * HIDDEN) @ p["a"]).reshape(width, m, ATTEND)
        s = e @ p["v"]
        if not whole:
            s = np.where(np.arange(width)[:, None] < np.maximum(size, 1), s, -1e9)
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        pooled = np.einsum("tm,tmh->mh", s, states)
        y = _sigmoid(pooled @ p["o"] + p["c"])
        return (y, (x, states, memo, e, s, pooled, width)) if keep else y

    def backward(self, dy, codes, begin, size, kept):
        """Gradients by name for d loss / d logit; those of the inputs come as (d x)."""
        x, states, memo, e, s, pooled, width = kept
        p, g = self.p, {}
        g["o"], g["c"] = pooled.T @ dy, np.array([dy.sum()], np.float32)
        dpool = dy[:, None] * p["o"]
        ds = np.einsum("mh,tmh->tm", dpool, states)
        dstates = s[:, :, None] * dpool
        ds = s * (ds - (s * ds).sum(axis=0))
        g["v"] = np.einsum("tm,tma->a", ds, e)
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["a"] = states.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, ATTEND)
        dstates += de @ p["a"].T
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u = p["u" + d]
            dgx = np.zeros((width, len(begin), 3 * HIDDEN), np.float32)
            du, dh = np.zeros_like(u), np.zeros((len(begin), HIDDEN), np.float32)
            for q in range(width):
                t = width - 1 - q if d == "f" else q
                h, r, z, n, ghn = memo[d, t]
                dh = dh + dstates[t, :, part]
                live = (t < size)[:, None]
                dn = dh * (1 - z) * (1 - n * n) * live
                dz = dh * (h - n) * z * (1 - z) * live
                dr = dn * ghn * r * (1 - r)
                dgx[t] = np.concatenate([dr, dz, dn], axis=1)
                dgh = np.concatenate([dr, dz, dn * r], axis=1)
                du += h.T @ dgh
                dh = np.where(live, dh * z + dgh @ u.T, dh)
            at = codes[np.minimum(begin[None] + np.arange(width)[:, None], len(codes) - 1)].ravel()
            flat = dgx.reshape(-1, 3 * HIDDEN)
            per = np.stack([np.bincount(at, weights=flat[:, j], minlength=len(x)) for j in range(flat.shape[1])], axis=1).astype(np.float32)
            g["u" + d], g["k" + d], g["w" + d] = du, per.sum(axis=0), x.T @ per
            dx += per @ p["w" + d].T
        return g, dx

    def score(self, texts: pa.Array, chunk: int = 2048) -> np.ndarray:
        """Score of each text: its highest window's probability."""
        w = Words(texts)
        x, _ = self.inputs(w)
        begin, size, text = windows(w.at)
        y = np.zeros(len(begin), np.float32)
        # windows of one length go together, so full ones need no masks
        order = np.argsort(-size, kind="stable")
        for i in range(0, len(order), chunk):
            j = order[i : i + chunk]
            y[j] = self.forward(x, w.codes, begin[j], size[j])
        out = np.zeros(len(texts))
        np.maximum.at(out, text, y)
        return out


def train(texts: list[str], toxic: list[int], odds: float | None = None, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED, log: list | None = None) -> Net:
    """Network fitted to texts with labels; odds: those of label 1 where the texts were drawn from, if they were drawn unevenly."""
    net, rng = Net(seed), np.random.default_rng(seed)
    w = Words(pa.array(texts, pa.string()))
    begin, size, text = windows(w.at)
    y = np.asarray(toxic, np.float32)[text]
    use = size > 0
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items() if k not in ("ew", "ec")}
    squares = {"ew": np.full(WORDS, 1e-4, np.float32), "ec": np.full(GRAMS, 1e-4, np.float32)}
    data, off = w.bytes()
    word = word_hash(data, off, WORDS)
    owner, gram = ngrams(data, off, SIZES, GRAMS)
    order = np.argsort(owner, kind="stable")
    owner, gram = owner[order], gram[order]
    at = np.searchsorted(owner, np.arange(len(w.words) + 1))
    usual = np.bincount(np.unique(np.stack([w.doc, w.codes]), axis=1)[1], minlength=len(w.words)) >= USUAL
    ones = sum(toxic)
    shift = np.float32(np.log(max(ones, 1) / max(len(toxic) - ones, 1) / odds)) if odds else np.float32(0)
    step = 0
    net.p["c"] += shift
    often = max(1, -(-STEPS * BATCH // max(NOISY * min(3 * int((y > 0).sum()), len(y)), 1))) if y.any() else 1
    noisy, epochs = NOISY * often, epochs * often
    for epoch in range(epochs):
        seen = np.zeros(len(begin), np.float32)
        pos, neg = np.flatnonzero(use & (y > 0)), np.flatnonzero(use & (y == 0))
        ids = rng.permutation(np.concatenate([pos, rng.permutation(neg)[: max(2 * len(pos), BATCH) if epoch < noisy else None]]))
        for i in range(0, len(ids), BATCH):
            b = ids[i : i + BATCH]
            rows = np.minimum(begin[b][None] + np.arange(int(size[b].max()))[:, None], len(w.codes) - 1)
            own, local = np.unique(w.codes[rows], return_inverse=True)
            # a batch has its own small table of words
            n = at[own + 1] - at[own]
            g_owner = np.repeat(np.arange(len(own)), n)
            g_gram = gram[np.repeat(at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            count = np.sqrt(np.maximum(n, 1)).astype(np.float32)
            common = usual[own]
            x = net.p["ew"][word[own]] * common[:, None]
            for j in range(DIM):
                x[:, j] += np.bincount(g_owner, weights=net.p["ec"][g_gram, j], minlength=len(own)) / count
            width = rows.shape[0]
            codes = local.reshape(rows.shape).T.ravel()
            start = np.arange(len(b)) * width
            prob, kept = net.forward(x, codes, start, size[b], keep=True)
            seen[b] = prob
            if log is not None:
                log.append(float(-np.log(np.where(y[b] > 0, prob, 1 - prob) + 1e-9).mean()))
            g, dx = net.backward((prob - y[b]) / len(b), codes, start, size[b], kept)
            step += 1
            for k, (m1, m2) in moment.items():
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.001 * (g[k] * g[k] - m2)
                net.p[k] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            for k, index, grad in (("ew", word[own][common], dx[common]), ("ec", g_gram, dx[g_owner] / count[g_owner, None])):
                hit, inv = np.unique(index, return_inverse=True)
                total = np.stack([np.bincount(inv, weights=grad[:, j], minlength=len(hit)) for j in range(DIM)], axis=1).astype(np.float32)
                squares[k][hit] += (total * total).mean(axis=1)
                net.p[k][hit] -= 10 * rate * total / np.sqrt(squares[k][hit])[:, None]
        if epoch + 1 >= noisy:
            use = (size > 0) & ((y == 0) | (seen >= 0.5))
    net.p["c"] -= shift
    return net


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample: int = SAMPLE) -> Net | None:
    """Network from at most sample labelled rows, drawn by a digest of the id, evenly from both labels, before the shift."""
    odds = {r["y"]: r["n"] for r in labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a label
    rows = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.lit("toxicity"), F.col(id_col)).alias("mark"))
    # one bounded top list per label and bucket, four times as long as its share of the sample, then one per label: no label fills a task
    few = min(sample // 2, sample // 32 + 16)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("y", F.pmod("mark", F.lit(64))).orderBy("mark", "doc_id"))).where(F.col("r") <= few)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("mark", "doc_id"))).where(F.col("r") <= sample // 2)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= LONGEST)
    one = lambda ids: base.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # noqa: E731  of a repeated id the text of least digest
    got = one(first).join(F.broadcast(first.select("doc_id", "y", "mark")), "doc_id")  # at most sample rows
    texts, marks = [], []
    for r in sorted(got.toLocalIterator(), key=lambda r: (r["mark"], r["text"])):
        texts.append(r["text"])
        marks.append(r["y"])
    if not texts:
        return None
    return train(texts, marks, max(odds.get(1, 0), 1) / max(odds.get(0, 0), 1))


def _logit(score):
    return F.log(F.greatest(score, F.lit(1e-9))) - F.log(F.greatest(1 - score, F.lit(1e-9)))


def offset(scored: DataFrame, labels: DataFrame, id_col="doc_id", label_col="toxic") -> float:
    """The shift of the logit by all labelled rows of scored (doc_id, score). A repeated id has the highest of its scores."""
    rows = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    # a step of the shift tells its scores no further apart, so one stands for all of a step and label
    step = F.floor(F.least(F.greatest(_logit(F.col("score")), F.lit(-SHIFTS[1])), F.lit(SHIFTS[-1])) / SHIFTS[1])
    seen = scored.groupBy("doc_id").agg(F.max("score").alias("score")).join(rows, "doc_id")
    got = seen.groupBy("y", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("y", "step").collect()  # a row a label and step
    ends = pa.array(np.cumsum([r["n"] for r in got]), pa.int64())
    runs = lambda v, kind: pa.RunEndEncodedArray.from_arrays(ends, pa.array(v, kind))
    middle = [(r["step"] + 0.5) * SHIFTS[1] for r in got]
    return shift(runs([r["y"] for r in got], pa.int32()), runs([_sigmoid(x) for x in middle], pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample: int = SAMPLE) -> Net | None:
    """Network as by ``learn``, with its output shifted by all labelled rows."""
    net = learn(docs, labels, id_col, text_col, label_col, sample)
    if net is not None:
        every = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        net.p["c"] -= np.float32(offset(score(every, net).select("doc_id", "score"), labels, id_col, label_col))
    return net


def shift(y, scores) -> float:
    """The shift of the logit, from 0 to 4, with the least weighted errors; the middle of the best ones in a row, 0 without documents of both kinds. Labels and scores are arrays, or run-end encoded in the same runs."""
    n = 1
    if isinstance(y, pa.RunEndEncodedArray):
        n = np.diff(y.run_ends.to_numpy(), prepend=0)
        y, scores = y.values.to_numpy(), scores.values.to_numpy()
    if not (y > 0).any() or not (y == 0).any():
        return 0.0
    logit = np.log(np.maximum(scores, 1e-9)) - np.log(np.maximum(1 - scores, 1e-9))
    grid = SHIFTS
    cost = np.array([(n * (MISSED * ((y > 0) & (logit < g)) + ((y == 0) & (logit >= g)))).sum() for g in grid])
    best = np.flatnonzero(cost == cost.min())
    run = best[: int(np.argmax(np.append(np.diff(best) > 1, True))) + 1]
    return float(grid[run].mean())


def score(docs: DataFrame, net: Net | None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by WORDS, GRAMS and DIM

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = sent.value.score(part.column("text")) if sent.value else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op4_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    net = learn(docs, labels)
    scored = score(docs, net).select("doc_id", "score")
    if net is not None:  # scored once: the shift is taken from the stored scores, and they are set back by it
        scored = materialize(scored, "toxicity")
        scored = scored.withColumn("score", 1 / (1 + F.exp(offset(scored, labels) - _logit(F.col("score")))))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
