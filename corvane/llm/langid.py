"""Language identification: script ranges narrow the candidates, Viterbi labels the words.

Every distinct word of a batch is scored once per language by the log-odds of its hashed byte
n-grams. The share of each script among a word's characters decides which languages may label it:
those in whose training texts the script is usual. Viterbi over the words of a text, with a penalty
for each switch of language, gives spans; the language with most letters in its spans labels the
text, and the score is that language's share when the words' summed scores, over the root of their number, are
taken for log-odds.

The n-gram tables are counted on a sample of at most ``SAMPLE`` labelled rows of at most ``LONGEST`` bytes, spread over the
``LANGUAGES`` most frequent languages and drawn by a digest of the id; the sample is the one bounded part, everything else
covers all words of all texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; null languages teach
nothing; without any labelled row everything is ``und``; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .tokens import SLICE_BYTES, Words, ngrams, slices

SAMPLE = 4000
#: Bytes of the longest text that the fit reads, so that the driver holds at most SAMPLE times as many (of more languages than that, one text each).
LONGEST = 1 << 17
SPACE = 1 << 16
SIZES = (1, 2, 3, 4)
SWITCH = 6.0
UND = "und"
#: First code points of script ranges, and their names; fixed values.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
#: A language may label words of a script that makes up at least this part of its letters.
USUAL = 0.01


def _letters(words: pa.Array) -> np.ndarray:
    """Number of letters in each word."""
    return pc.utf8_length(pc.replace_substring_regex(words, r"\P{L}+", "")).to_numpy(zero_copy_only=False).astype(np.int64)


def _scripts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(words, scripts): number of letters of each script, by the lead bytes of UTF-8."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    d = data[off[0] : off[-1]].astype(np.int64)
    d = np.concatenate([d, np.zeros(3, np.int64)])
    a, b, c = d[:-3], d[1:-2] & 63, d[2:-1] & 63
    cp = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, 0x20000)))
    lead = (a & 0xC0) != 0x80
    plain = (cp < 0x80) & ~(((cp >= 65) & (cp <= 90)) | ((cp >= 97) & (cp <= 122)))
    lead &= ~plain
    names = np.array([NAMES.index(n) for _, n in SCRIPTS])
    s = names[np.maximum(np.searchsorted([x for x, _ in SCRIPTS], cp[lead], side="right") - 1, 0)]
    return np.bincount(owner[lead] * len(NAMES) + s, minlength=(len(off) - 1) * len(NAMES)).reshape(-1, len(NAMES))


class Model:
    """Log-odds tables: langs, (languages, SPACE) n-gram scores, (languages, scripts) masks."""

    def __init__(self, langs, grams, usual):
        self.langs, self.grams, self.usual = list(langs), grams, usual

    @classmethod
    def fit(cls, texts, langs):
        names = sorted(set(langs))
        if not names:
            return cls([], np.zeros((0, SPACE), np.float32), np.zeros((0, len(NAMES)), bool))
        counts = np.zeros((len(names), SPACE))
        scripts = np.zeros((len(names), len(NAMES)))
        for k, lang in enumerate(names):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for i in range(0, len(own), 200):
                w = Words(pa.array(own[i : i + 200], pa.string()))
                n = np.bincount(w.codes, minlength=len(w.words)).astype(float)
                data, off = w.bytes()
                # a word counts by the root of its frequency, so a few common words don't outweigh the rest
                owner, bucket = ngrams(data, off, SIZES, SPACE)
                counts[k] += np.bincount(bucket, weights=np.sqrt(n)[owner], minlength=SPACE)
                scripts[k] += _scripts(data, off).T @ n
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * SPACE)
        grams = np.log(p) - np.log(p).mean(axis=0, keepdims=True)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        return cls(names, grams.astype(np.float32), share >= USUAL)

    def words(self, w: Words) -> np.ndarray:
        """(distinct words, languages): score of each word; languages that its script rules out lie far below."""
        data, off = w.bytes()
        owner, bucket = ngrams(data, off, SIZES, SPACE)
        out = np.empty((len(w.words), len(self.langs)), np.float32)
        n = np.maximum(np.bincount(owner, minlength=len(w.words)), 1)
        for k, g in enumerate(self.grams):
            out[:, k] = np.bincount(owner, weights=g[bucket], minlength=len(w.words)) / np.sqrt(n)
        s = _scripts(data, off)
        main = s.argmax(axis=1)
        ruled = ~self.usual[:, main].T & (s.sum(axis=1) > 0)[:, None]
        ruled &= ~ruled.all(axis=1)[:, None]
        out[ruled] -= 50.0
        return out


CHUNK = 512


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH, chunk: int = CHUNK) -> np.ndarray:
    """Best label of each word of the texts at[i]:at[i+1], with a penalty for each switch between neighbours.

    Texts are cut into chunks that advance together. A first pass finds, for every label before a
    chunk, the best score of every label at its end; these are chained along each text, which fixes
    the labels where chunks meet; a second pass traces all chunks back at once.
    """
    n, k = scores.shape
    size = np.diff(at)
    parts = -(-size // chunk)
    text = np.repeat(np.arange(len(size)), parts)
    c = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = at[:-1][text] + c * chunk
    width = np.minimum(size[text] - c * chunk, chunk)
    s = np.ascontiguousarray(scores.T, dtype=np.float32)

    def steps(which):
        """Chunks ordered by falling width, and how many of them reach each step."""
        order = which[np.argsort(-width[which], kind="stable")]
        w = width[order]
        return order, len(w) - np.searchsorted(w[::-1], np.arange(w[0] if len(w) else 0), side="right")

    through = np.zeros((k, k, len(text)), np.float32)
    order, live = steps(np.flatnonzero(parts[text] > 1))
    v = np.full((k, k, len(order)), -1e30, np.float32)
    v[np.arange(k), np.arange(k)] = 0
    for t, m in enumerate(live):
        here = v[:, :, :m]
        np.maximum(here, here.max(axis=0) - switch, out=here)
        here += s[:, None, begin[order[:m]] + t]
    through[:, :, order] = v
    # chain the chunks of each text: values before each chunk
    first = np.cumsum(parts) - parts
    before = np.zeros((k, len(text)), np.float32)
    for x in range(1, int(parts.max()) if len(parts) else 0):
        now = first[parts > x] + x
        before[:, now] = (before[:, now - 1][None] + through[:, :, now - 1]).max(axis=1)
    order, live = steps(np.arange(len(text)))
    came = np.full((k, n), -1, np.int16)
    v = before[:, order].copy()
    for t, m in enumerate(live):
        here, row = v[:, :m], begin[order[:m]] + t
        top = here.max(axis=0)
        moved = here < top - switch
        if moved.any():
            came[:, row] = np.where(moved, here.argmax(axis=0), -1)
            np.maximum(here, top - switch, out=here)
        here += s[:, row]
    state = np.zeros(len(text), np.int16)
    state[order] = v.argmax(axis=0)
    for x in range(int(parts.max()) - 1 if len(parts) else 0, 0, -1):
        now = first[parts > x] + x
        reach = before[:, now] + through[state[now], :, now].T
        state[now - 1] = reach.argmax(axis=0)
    out = np.zeros(n, np.int16)
    state = state[order]
    for t in range(len(live) - 1, -1, -1):
        row = begin[order[: live[t]]] + t
        now = state[: live[t]]
        out[row] = now
        back = came[now, row]
        np.copyto(now, back, where=back >= 0)
    return out


def label(model: Model, texts: pa.Array):
    """For each text: (language, score, spans); spans are (first word, end word, language) lists as arrays."""
    w = Words(texts)
    docs = len(texts)
    if not model.langs:
        return [UND] * docs, np.zeros(docs), w, np.zeros(0, np.int16)
    letters = _letters(w.words)[w.codes] if len(w.words) else np.zeros(0, np.int64)
    table_ = model.words(w) if len(w.words) else np.zeros((0, len(model.langs)), np.float32)
    scores = table_[w.codes] * (letters > 0)[:, None]
    k = len(model.langs)
    marks = viterbi(scores, w.at, chunk=max(CHUNK, 8 * k))  # what a chunk passes on is k x k
    mass = np.bincount(w.doc * k + marks, weights=letters, minlength=docs * k).reshape(docs, k)
    best = mass.argmax(axis=1)
    total = np.stack([np.bincount(w.doc, weights=scores[:, j], minlength=docs) for j in range(k)], axis=1)
    n = np.maximum(np.diff(w.at), 1)
    z = total / np.sqrt(n)[:, None]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p = (p / p.sum(axis=1, keepdims=True))[np.arange(docs), best]
    found = mass.sum(axis=1) > 0
    return [model.langs[b] if f else UND for b, f in zip(best, found, strict=True)], np.where(found, p, 0.0), w, marks


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample: int = SAMPLE) -> Model:
    """Model of every language there is, from at most sample rows (or one a language, if that is more), as many of each language as there are, drawn by a digest of id and text. Repeated rows count once."""
    told = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(F.col(text_col).cast("string")) <= LONGEST))
    told = told.select(F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col)).alias("mark"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = told.select("lang", "mark")
    per = max(1, sample // max(1, rows.select("lang").distinct().count()))
    # one bounded top list per language and bucket, four times as long as its share of the sample, then one per language: no language fills a task
    few = min(per, per // 16 + 16)
    place = lambda *by: F.dense_rank().over(Window.partitionBy("lang", *by).orderBy("mark"))
    first = rows.withColumn("r", place(F.pmod("mark", F.lit(64)))).where(F.col("r") <= few).select("lang", "mark").distinct()
    drawn = first.withColumn("r", place()).where(F.col("r") <= per).select("lang", "mark")
    got = told.join(F.broadcast(drawn), ["lang", "mark"], "left_semi").dropDuplicates(["lang", "mark"]).select("text", "lang").toLocalIterator()  # at most sample rows, or one a language
    texts, marks = [], []
    for r in got:
        texts.append(r["text"])
        marks.append(r["lang"])
    return Model.fit(texts, marks)


def identify(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, and on request spans (array of first word, end word, lang) and the columns in keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SPACE and the number of languages
    limit = SLICE_BYTES * 64 // max(64, len(model.langs))  # a word has a score in each language
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<begin:int,end:int,lang:string>>" * spans
    more = [c for c in keep if c not in (id_col, "doc_id", "lang_pred", "score", "spans")]
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    names_ = ["doc_id", "lang_pred", "score", *["spans"] * spans, *more]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", limit):
                names, score, w, marks = label(sent.value, part.column("text"))
                cols = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    every = []
                    for a, b in zip(w.at[:-1], w.at[1:], strict=True):
                        m = marks[a:b] if len(marks) else []
                        cut = np.flatnonzero(np.diff(m, prepend=-1)) if len(m) else []
                        every.append([{"begin": int(x), "end": int(y), "lang": sent.value.langs[m[x]]} for x, y in zip(cut, np.append(cut[1:], len(m)), strict=True)] if len(m) else [])
                    cols.append(pa.array(every, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                cols += [part.column(f"keep_{i}") for i in range(len(more))]
                yield pa.RecordBatch.from_arrays(cols, names_)

    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(more)]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *kept).mapInArrow(run, schema)


def held_out(column, parts: int, part: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def op7_langid(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 3, 1)))
    return identify(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
