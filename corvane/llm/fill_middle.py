"""Fill-in-middle transformation by a parallel scan of an automaton.

A text is cut between units (lines here) into prefix, middle and suffix, and written in one of two orders with
marks between the parts. A finite automaton over UTF-8 bytes tells where units end and whether the text holds a
mark already. It needn't be run from the first byte: a chunk emits its transition function (the state after it,
for every state before it) and the number of units that end in it, for every state before it. Both compose
associatively, so chunks are scanned side by side; composing what they emit gives each chunk's entry state and
the units before it, and so the chunk that holds a cut, where the cut is selected by walking down the tree of
partial compositions.

Texts of at most ``CHUNK`` bytes are one chunk, and all in a slice are scanned as one stream, in which the end of
a text is a symbol of its own. Longer texts are written once and cut into chunks that any task can scan; only
transition functions, and the chunks with a cut, are moved again.

Defined results: a null or empty text has no units and is left plain, as is one that holds a mark; a null id draws
like an empty string; repeated rows give equal rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import slices

#: Marks before prefix, suffix and middle; fixed values.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes that are scanned as one; a longer text is cut into chunks of so many.
CHUNK = 1 << 16


class Automaton:
    """A finite automaton over classes of bytes. step[s, c]: the state after class c in state s; ends[s, c]: units that end with it. The last class is the end of the text, which leads to state 0. In states of marked a mark was found."""

    def __init__(self, of_byte: np.ndarray, step: np.ndarray, ends: np.ndarray, marked: np.ndarray):
        self.of_byte, self.step, self.ends, self.marked = of_byte, step, ends, marked
        self.states = len(step)
        self.end = step.shape[1] - 1
        #: a class that changes nothing more and ends no unit when it comes again: its runs count as one
        self.settles = np.array([(step[step[:, c], c] == step[:, c]).all() and not ends[step[:, c], c].any() for c in range(step.shape[1])])

    def symbols(self, data: np.ndarray, ends: np.ndarray | None = None):
        """(class, byte offset after it) of each symbol, runs shortened; ends: offsets where texts end, in rising order."""
        ends = np.zeros(0, np.int64) if ends is None else ends
        cls = self.of_byte[data]
        keep = np.ones(len(cls), bool)
        keep[1:] = (cls[1:] != cls[:-1]) | ~self.settles[cls[1:]]
        keep[ends[ends < len(cls)]] = True  # the next text begins anew
        at = np.flatnonzero(keep)
        spot = np.searchsorted(at, ends)  # an end comes before the bytes from its offset on
        return np.insert(cls[at], spot, self.end).astype(np.int64), np.insert(at + 1, spot, ends)

    def scan(self, sym: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Levels of partial compositions, from single symbols up to the whole: (state after, units ended) for each state before."""
        f = np.ascontiguousarray(self.step.T[sym]).astype(np.int16)
        n = np.ascontiguousarray(self.ends.T[sym]).astype(np.int64)
        levels = [(f, n)]
        while len(f) > 1:
            odd = len(f) % 2
            left, right, nl, nr = f[: len(f) - odd : 2], f[1::2], n[: len(f) - odd : 2], n[1::2]
            rows = np.arange(len(left))[:, None]
            up, un = right[rows, left], nl + nr[rows, left]
            f, n = (np.concatenate([up, f[-1:]]), np.concatenate([un, n[-1:]])) if odd else (up, un)
            levels.append((f, n))
        return levels

    def entries(self, levels, entry: int) -> np.ndarray:
        """The state before each symbol, from the state before the first, down the levels."""
        s = np.array([entry], np.int64)
        for f, _ in levels[-2::-1]:
            odd = len(f) % 2
            down = np.empty(len(f), np.int64)
            down[::2] = s
            pairs = len(f) // 2
            down[1::2] = f[: len(f) - odd : 2][np.arange(pairs), s[:pairs]]
            s = down
        return s

    def select(self, levels, entry: int, k: int) -> int:
        """Which symbol ends the k-th unit (from 1), walking down the levels."""
        i, s = 0, entry
        for f, n in levels[-2::-1]:
            i *= 2
            if i + 1 < len(f) and n[i, s] < k:
                k -= int(n[i, s])
                s = int(f[i, s])
                i += 1
        return i

    def compose(self, f: np.ndarray, n: np.ndarray):
        """Of chunks in order: (state before, units before) of each and of what follows the last, from state 0."""
        state, units = np.zeros(len(f) + 1, np.int64), np.zeros(len(f) + 1, np.int64)
        for i in range(len(f)):
            state[i + 1], units[i + 1] = f[i, state[i]], units[i] + n[i, state[i]]
        return state, units


@lru_cache(4)
def lines(marks: tuple[str, ...] = MARKS) -> Automaton:
    """Units are lines with their line feed; a last line may lack it. Runs beside a search for the marks."""
    words = [m.encode() for m in marks]
    used = sorted(set(b"".join(words)) | {10})
    of_byte = np.zeros(256, np.uint8)
    of_byte[used] = np.arange(1, len(used) + 1)
    heads = sorted({w[:i] for w in words for i in range(len(w))}, key=lambda h: (len(h), h))  # what of a mark has been read
    found = len(heads)

    def after(head: bytes, byte: int) -> int:
        read = head + bytes([byte])
        if any(read.endswith(w) for w in words):
            return found
        return max((i for i, h in enumerate(heads) if read.endswith(h)), key=lambda i: len(heads[i]))

    seek = np.array([[0] + [after(h, b) for b in used] for h in heads] + [[found] * (len(used) + 1)])
    newline = 1 + used.index(10)
    # a state is that of the search, twice, plus 1 inside a line
    states = 2 * (found + 1)
    step = np.zeros((states, len(used) + 2), np.int64)
    ends = np.zeros_like(step)
    for s in range(states):
        for c in range(len(used) + 1):
            step[s, c] = 2 * seek[s // 2, c] + (c != newline)
            ends[s, c] = c == newline
        ends[s, -1] = s % 2  # the end of the text ends a line that has begun
    return Automaton(of_byte, step, ends, np.arange(states) // 2 == found)


def _cut(n: int, h1: int, h2: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


_CUTS = "n long, low long, high long, marked boolean"


def _small(batches):
    auto = lines()
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").cast(pa.large_binary())
            _, off, data = texts.buffers()
            off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
            off = off - off[0]
            sym, at = auto.symbols(data, off[1:])
            before = auto.entries(auto.scan(sym), 0)
            last = np.flatnonzero(sym == auto.end)
            hit = np.flatnonzero(auto.ends[before, sym])
            ends = at[hit]
            bound = np.searchsorted(hit, last, side="right")
            n = np.diff(bound, prepend=0)
            h = [part.column(c).to_numpy().astype(np.int64) % (n + 1) for c in ("h1", "h2")]
            cut = []
            for k in (np.minimum(*h), np.maximum(*h)):
                i = bound - n + k - 1
                cut.append(np.where(k > 0, np.append(ends, 0)[np.where(k > 0, i, -1)], off[:-1]) - off[:-1])
            cols = [pa.array(x) for x in (n, *cut, auto.marked[before[last]])]
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, "n", "low", "high", "marked"])


def _functions(batches):
    """(row, chunk, f, units): what each chunk emits."""
    auto = lines()
    for batch in batches:
        tops = [auto.scan(auto.symbols(np.frombuffer(data, np.uint8))[0])[-1] for data in batch.column("bytes").to_pylist()]
        f, n = ([t[k][0].tolist() for t in tops] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(f, pa.list_(pa.int16())), pa.array(n, pa.list_(pa.int64()))], ["row", "chunk", "f", "units"])


_PLACES = pa.schema([("row", pa.int64()), ("which", pa.int32()), ("n", pa.int64()), ("marked", pa.bool_()), ("chunk", pa.int32()), ("state", pa.int32()), ("k", pa.int64())])


def _resolve(t: pa.Table) -> pa.Table:
    """Of one text's functions: its number of units, whether it holds a mark, and for each cut its chunk (null: the cut is at the text's end), the state before it, and which of its units the cut follows (0: none)."""
    auto = lines()
    t = t.sort_by("chunk")
    state, units = auto.compose(*(np.array(t.column(c).to_pylist(), np.int64) for c in ("f", "units")))
    n = int(units[-1] + auto.ends[state[-1], auto.end])
    row, h1, h2 = (t.column(c)[0].as_py() for c in ("row", "h1", "h2"))
    out = []
    for which, k in enumerate(_cut(n, h1, h2)):
        c = int(np.searchsorted(units, k)) - 1 if k else 0
        inside = c < len(t)
        out.append({"row": row, "which": which, "n": n, "marked": bool(auto.marked[state[-1]]), "chunk": c if inside else None, "state": int(state[c]) if inside else None, "k": k - int(units[c]) if inside else None})
    return pa.Table.from_pylist(out, _PLACES)


def _locate(chunk: int):
    """(row, which, n, marked, offset): the byte that each cut precedes, found in its chunk."""

    def run(batches):
        auto = lines()
        for batch in batches:
            t, offset = batch.to_pydict(), []
            for data, c, state, k, size in zip(t["bytes"], t["chunk"], t["state"], t["k"], t["size"], strict=True):
                if c is None or k == 0:
                    offset.append(size if c is None else c * chunk)
                else:
                    sym, after = auto.symbols(np.frombuffer(data, np.uint8))
                    offset.append(c * chunk + int(after[auto.select(auto.scan(sym), state, k)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "which", "n", "marked")), pa.array(offset, pa.int64())], ["row", "which", "n", "marked", "offset"])

    return run


def _long(texts: DataFrame, chunk: int) -> DataFrame:
    """The columns of _small for long texts, of which each chunk is a task's work of its own."""
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    piece = F.substring("text", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("bytes")
    every = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int"))
    chunks = texts.select("row", "text", F.explode(every).alias("chunk")).select("row", "chunk", piece).repartition("row", "chunk")
    emitted = chunks.mapInArrow(_functions, "row long, chunk int, f array<short>, units array<long>")
    places = emitted.join(texts.select("row", "h1", "h2"), "row").groupBy("row").applyInArrow(_resolve, "row long, which int, n long, marked boolean, chunk int, state int, k long")
    spots = places.join(texts.select("row", "text"), "row").select("row", "which", "n", "marked", "chunk", "state", "k", piece, F.octet_length("text").cast("long").alias("size"))
    found = spots.mapInArrow(_locate(chunk), "row long, which int, n long, marked boolean, offset long")
    cut = lambda w: F.max(F.when(F.col("which") == w, F.col("offset")))
    cuts = found.groupBy("row").agg(F.first("n").alias("n"), cut(0).alias("low"), cut(1).alias("high"), F.first("marked").alias("marked"))
    return texts.join(cuts, "row").drop("row")


def cut_texts(docs: DataFrame, id_col="doc_id", text_col="text", seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text as binary, h1 to h4, n, low, high, marked): draws, units, and the bytes that precede middle and suffix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *draws)
    kind = docs.schema[id_col].dataType.simpleString()
    short = texts.where(F.octet_length("text") <= chunk).mapInArrow(_small, f"doc_id {kind}, text binary, h1 long, h2 long, h3 long, h4 long, {_CUTS}")
    return short.unionByName(_long(texts.where(F.octet_length("text") > chunk), chunk))


def fill_in_middle(docs: DataFrame, id_col="doc_id", text_col="text", seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output): the texts with their middle moved to the end; rate and spm are percentages, of texts that are cut and of those whose suffix comes first. The parts of plain texts are null."""
    cut = cut_texts(docs, id_col, text_col, seed, chunk)
    plain = (F.octet_length("text") == 0) | F.col("marked") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    part = lambda a, b: F.when(F.col("form") != "plain", F.substring("text", a + 1, (b - a)).cast("string"))
    zero, low, high, size = F.lit(0), F.col("low").cast("int"), F.col("high").cast("int"), F.octet_length("text")
    parts = cut.withColumn("form", form).select("doc_id", "n", "form", F.col("text").cast("string").alias("text"), part(zero, low).alias("prefix"), part(low, high).alias("middle"), part(high, size).alias("suffix"))
    p, s, m = (F.lit(x) for x in MARKS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from, by the marks in it: a text that holds one itself is left plain."""
    p, s, m = MARKS

    def parts(mark: str):
        """What follows the first mark: up to mark, from there up to that of the middle, and the rest."""
        body = F.substring(output, len(p) + 1, F.length(output))
        first = F.substring_index(body, mark, 1)
        rest = F.substring(body, F.length(first) + len(mark) + 1, F.length(body))
        second = F.substring_index(rest, m, 1)
        return first, second, F.substring(rest, F.length(second) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(p)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def op13_fill_in_middle(spark, sf_dir) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    length = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", length("prefix"), length("middle"), digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS units
  FROM documents
), d AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS share
  FROM t
), p AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN share < 50 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(list_slice(units, 1, least(a, b)), ''), '') AS prefix,
    coalesce(array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), ''), '') AS middle,
    coalesce(array_to_string(list_slice(units, greatest(a, b) + 1, n), ''), '') AS suffix
  FROM d
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
