"""Alignment of two tokenizers' tokens by relational operations.

Tokens of either side are exploded with their positions, their sizes in bytes are summed up by a window to the byte
where each ends, and tokens of both sides that end together are met by an equi-join on text and end. An end that
both sides have is a cut; the running count of cuts before an end is the number of the group that its tokens belong
to. A side has one token for each end, so the full join of the sides is one grouping of their union by (text, end):
neither side is shuffled, and all of it runs in the stage that begins at a text's key. Links are the pairs that meet.

Texts repeat their words, so what is aligned is not the corpus but its distinct segments. A segment ends before a
space between two characters that aren't white space. Neither tokenizer can join or look across such a place (a
byte-level tokenizer's pattern begins a new piece there; the other has no piece with a space after another
character), so a text's tokens are its segments' tokens, and both sides end a token at each segment's end. A pair of
models without these properties takes whole texts for segments. Texts are read in blocks of ``BLOCK`` bytes, each
with its distinct segments; a block's texts are put together from what its segments were aligned to.

Counts of id pairs come from the segments, weighted by how often they occur. Pairs with over 1 part in 2^18 of all
links are fewer than 2^18 and are broadcast to the links; others are joined by shuffle.

Defined results: a text that is null, empty or not given back by its tokens has no tokens: zeros, and an empty
string for its groups; rows of null or repeated ids keep a row each; an empty table gives none. A special token's
string in a text is plain text.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table, tidy
from .tokens import slices

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose distinct segments are gathered; a longer text is a block of its own.
BLOCK = 32 << 20
#: A longer segment is known by its digest.
KEY = 64
#: Id pairs with over one part in this of all links are broadcast: fewer than this.
FREQUENT = 1 << 18
_SPACE = "▁"
_SEGMENT = re.compile(r"(?<=\S) (?=\S)")


class Models:
    """A byte-level tokenizer (A, reads a space before the text) and a piece tokenizer (B, which adds it)."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level entry shows as themselves; others follow from 256 on
        other = [x for x in range(256) if x not in printed]
        byte = {chr(x): x for x in printed} | {chr(256 + i): x for i, x in enumerate(other)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(byte[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        if max(map(len, self.a_bytes + self.b_bytes)) >> SIZE_BITS or max(len(self.a_bytes), len(self.b_bytes)) >> ID_BITS:
            raise ValueError("ids or tokens too large to be packed")
        self.packed = [np.array([(side << SIZE_BITS | len(x)) << ID_BITS | i for i, x in enumerate(entries)], np.int32) for side, entries in enumerate((self.a_bytes, self.b_bytes))]


        spec, proto = json.loads(a), sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(b)
        rule = proto.normalizer_spec
        whole = rule.name == "identity" and not rule.remove_extra_whitespaces and rule.add_dummy_prefix
        byte_level = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        #: whether tokens of segments are those of the text
        self.splits = byte_level and whole and not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        #: whether only a text with the mark for a space is not given back
        self.lossless = byte_level and whole and proto.trainer_spec.byte_fallback

    def encode(self, texts: list[str]):
        """Ids of both sides, text by text."""
        a = [x.ids for x in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def gives_back(self, text: str, a: list[int], b: list[int]) -> bool:
        want = b" " + text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))

    def exact(self, segments: list[str], known: dict) -> bool:
        """Whether the tokens of all segments give them back; known holds what was found before."""
        new = [s for s in dict.fromkeys(segments) if s not in known]
        known.update((s, self.gives_back(s, a, b)) for s, a, b in zip(new, *self.encode(new), strict=True))
        return all(map(known.__getitem__, segments))


def segments(text: str, splits: bool = True) -> list[str]:
    return _SEGMENT.split(text) if splits else [text]


_LOADED: dict[str, Models] = {}


def _load(files: tuple[bytes, bytes]) -> Models:
    """A worker's models, loaded once."""
    name = hashlib.sha256(b"".join(files)).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Models(*files)
    return _LOADED[name]


def _pack(codes: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


def _blocks(files, splits: bool, lossless: bool, limit: int, kind: pa.DataType):
    """A row for each block: its texts' ids, number of segments (-1: no tokens) and codes, and its distinct segments with their number."""

    def run(batches):
        known: dict = {}
        base, seq = TaskContext.get().partitionId() << 32, itertools.count()

        def flush():
            codes = np.concatenate(held) if held else np.zeros(0, np.uint32)
            names = list(lex)
            keys = [s if len(s) <= KEY else "sha256:" + hashlib.sha256(s.encode()).hexdigest() for s in names]
            cols = [pa.array([x], t) for x, t in (
                (base + next(seq), pa.int64()), (ids, pa.list_(kind)), (sizes, pa.list_(pa.int64())), (_pack(codes), pa.binary()),
                (keys, pa.list_(pa.string())), ([None if len(s) <= KEY else s for s in names], pa.list_(pa.string())), (np.bincount(codes, minlength=len(names)), pa.list_(pa.int64())),
            )]
            return pa.RecordBatch.from_arrays(cols, ["block", "ids", "sizes", "codes", "keys", "longs", "counts"])

        def fresh():
            lex = defaultdict()
            lex.default_factory = lex.__len__
            return [], [], [], lex, 0

        ids, sizes, held, lex, read = fresh()
        for batch in batches:
            for i, text in itertools.chain.from_iterable(zip(x.column("doc_id").to_pylist(), x.column("text").to_pylist(), strict=True) for x in slices(batch, "text")):
                if read and read + len(text or "") > limit:
                    yield flush()
                    ids, sizes, held, lex, read = fresh()
                    pa.default_memory_pool().release_unused()
                own = segments(text, splits) if text else []
                ok = text and (_SPACE not in text if lossless else _load(files.value).exact(own, known))
                ids.append(i)
                sizes.append(len(own) if ok else -1)
                if ok:
                    held.append(np.fromiter(map(lex.__getitem__, own), np.uint32, len(own)))
                read += len(text or "")
        if ids:
            yield flush()

    return run


#: Bits of a token's id and of its size in a packed token; the side is above them.
ID_BITS, SIZE_BITS = 20, 10


def _tokens(files):
    """(key, n, tokens) of texts (key, n, text): the tokens of both sides, first against second, each packed into a number: side, size, id."""

    def run(batches):
        models = _load(files.value)
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.column("text").to_pylist()
                both = models.encode(names)
                for name, a, b in zip(names, *both, strict=True):
                    if not models.gives_back(name, a, b):
                        raise ValueError("a segment was taken for one that its tokens give back")
                sides = [x for pair in zip(*both, strict=True) for x in pair]
                n = np.array([len(x) for x in sides], np.int64)
                ids = np.fromiter(itertools.chain.from_iterable(sides), np.int32, int(n.sum()))
                side = np.repeat(np.arange(len(sides)) % 2, n)
                packed = np.where(side == 0, models.packed[0][np.where(side == 0, ids, 0)], models.packed[1][np.where(side == 1, ids, 0)])
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])[::2], pa.int32()), pa.array(packed))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), tokens], ["key", "n", "tokens"])

    return run


def align(tokens: DataFrame, by=("key",)) -> DataFrame:
    """(key, end, a, b, g): every end of a token in a text, the tokens of either side that end there (null: none), and their group. tokens: (key, pos, side, id, size), side 0 or 1, in order of pos; by names the columns of the key."""
    so_far = Window.partitionBy(*by, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = tokens.select(*by, "side", "id", F.sum("size").over(so_far).alias("end"))
    met = ends.groupBy(*by, "end").agg(F.max(F.when(F.col("side") == 0, F.col("id"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("id"))).alias("b"))
    before = Window.partitionBy(*by).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("g", F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).over(before))


def _spell(batches):
    """(key, n, n_a, n_b, n_groups, groups, links) of segments (key, n, ends): ends (end, a, b, g) in order, with null ids where a side has no token."""
    link = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    names = ["key", "n", "n_a", "n_b", "n_groups", "groups", "links"]
    for batch in batches:
        ends = batch.column("ends")
        size = ends.value_lengths().to_numpy()
        flat = ends.flatten()
        a, b, g = (flat.field(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("a", "b", "g"))
        own = np.repeat(np.arange(batch.num_rows), size)
        count = lambda has: np.bincount(own[has], minlength=batch.num_rows)  # noqa: E731, B023
        cut = (a >= 0) & (b >= 0)
        # groups of all segments are numbered on, and the tokens of one brought together, first those of a
        group = np.concatenate([[0], np.cumsum(count(cut))])[own] + g
        ids, side, group = np.concatenate([a, b]), np.repeat([0, 1], len(a)), np.tile(group, 2)
        has = ids >= 0
        ids, side, group = ids[has], side[has], group[has]
        order = np.argsort(2 * group + side, kind="stable")
        ids, side, group = ids[order].astype(str).tolist(), side[order], group[order]
        apart = np.full(len(ids), 44, np.uint8)  # what stands before a token: a comma, or the end of a side or a group
        apart[1:][side[1:] != side[:-1]] = 124
        apart[1:][group[1:] != group[:-1]] = 59
        marks = apart.tobytes().decode()
        first = np.concatenate([[0], np.cumsum(count(a >= 0) + count(b >= 0))]).tolist()
        spelled = ["".join([x for k in range(p, q) for x in (marks[k], ids[k])])[1:] for p, q in itertools.pairwise(first)]
        links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count(cut))]), pa.int32()), pa.StructArray.from_arrays([pa.array(a[cut], pa.int32()), pa.array(b[cut], pa.int32())], fields=list(link)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), *(pa.array(count(x), pa.int64()) for x in (a >= 0, b >= 0, cut)), pa.array(spelled, pa.string()), links], names)


def _entries(texts: DataFrame, files) -> DataFrame:
    """(key, n, n_a, n_b, n_groups, groups, links): each text (key, text, n) aligned; its groups as a string, and the id pairs that it links."""
    packed = texts.select("key", "n", "text").mapInArrow(_tokens(files), "key string, n long, tokens array<int>").repartition("key")  # all that follows stays in these partitions
    bits = lambda low, n: F.shiftright("col", low).bitwiseAND((1 << n) - 1)
    tokens = packed.select("key", "n", F.posexplode("tokens")).select("key", "n", "pos", bits(ID_BITS + SIZE_BITS, 1).alias("side"), bits(0, ID_BITS).alias("id"), bits(ID_BITS, SIZE_BITS).alias("size"))
    ends = align(tokens, ("key", "n")).groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("end", "a", "b", "g"))).alias("ends"))
    return ends.mapInArrow(_spell, "key string, n long, n_a long, n_b long, n_groups long, groups string, links array<struct<a int, b int>>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): how often each id pair is linked, links (a, b, n) occurring n times, and whether no other pair of b is more often."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _sums(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, count_sum, n_best): over the links (key, a, b) of each segment."""
    total = pairs.agg(F.sum("count")).head()[0] or 0
    often = F.col("count") * FREQUENT > total
    mark = pairs.where(often).select("a", "b", "count", "best")
    near = links.join(F.broadcast(mark), ["a", "b"], "left")  # fewer than FREQUENT rows
    far = near.where("count is null").select("key", "a", "b").join(pairs.where(~often), ["a", "b"])
    every = near.where("count is not null").select("key", "count", "best").unionByName(far.select("key", "count", "best"))
    return every.groupBy("key").agg(F.sum("count").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best"))


def _assemble(kind: pa.DataType, keep: bool):
    """The rows of a block's texts, from its codes and what its segments are aligned to."""
    fields = [("doc_id", kind), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string()), *([("groups", pa.string())] if keep else [])]

    def run(block: pa.Table, lex: pa.Table) -> pa.Table:
        at = lex.column("code").to_numpy()
        groups = [b""] * len(at)
        for i, g in zip(at.tolist(), lex.column("groups").cast(pa.binary()).to_pylist(), strict=True):
            groups[i] = g
        numbers = np.zeros((5, len(at)), np.int64)
        for k, c in enumerate(("n_a", "n_b", "n_groups", "n_best", "count_sum")):
            numbers[k, at] = lex.column(c).to_numpy()
        del lex
        rows = []
        for r in block.to_pylist():
            codes = _unpack(r["codes"], sum(n for n in r["sizes"] if n > 0))
            at = 0
            for i, n in zip(r["ids"], r["sizes"], strict=True):
                own = codes[at : at + max(n, 0)]
                at += len(own)
                s = b";".join(map(groups.__getitem__, own.tolist()))
                a, b, g, best, count = numbers[:, own].sum(axis=1).tolist()
                rows.append((i, a, b, g, g, best, count, hashlib.sha256(s).hexdigest() if len(own) else "", *([s.decode()] if keep else [])))
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

    return run


def align_texts(docs: DataFrame, id_col="doc_id", text_col="text", a_path: str = A_PATH, b_path: str = B_PATH, block: int = BLOCK, groups: bool = False, whole: bool = False) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; on request the groups themselves (`a1,a2|b1;a3|b2`). With whole, as for models of other kinds, segments are whole texts, and every one is encoded to see whether it is given back. The models' files are read where the driver runs."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        models = _load(both := (a.read(), b.read()))
    files = spark.sparkContext.broadcast(both)  # the models, some 2 MB
    kind = to_arrow_type(docs.schema[id_col].dataType)
    name = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"block long, ids array<{name}>, sizes array<long>, codes binary, keys array<string>, longs array<string>, counts array<long>"
    with tidy(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}):  # texts are long
        blocks = materialize(base.mapInArrow(_blocks(files, models.splits and not whole, models.lossless and not whole, block, kind), schema), "align-blocks")
        words = blocks.select("block", F.posexplode(F.arrays_zip("keys", "longs", "counts"))).select("block", F.col("pos").alias("code"), F.col("col.keys").alias("key"), F.col("col.longs").alias("long"), F.col("col.counts").alias("n"))
        short = words.where("long is null").groupBy("key").agg(F.sum("n").alias("n"))
        long = words.where("long is not null").groupBy("key").agg(F.sum("n").alias("n"), F.first("long").alias("text"))
        entries = materialize(_entries(short.withColumn("text", F.col("key")), files).unionByName(_entries(long, files)), "align-entries")
        links = entries.select("key", "n", F.explode("links").alias("l")).select("key", "n", "l.a", "l.b")
        pairs = materialize(pair_counts(links), "align-pairs")
        whole = entries.drop("links", "n").join(_sums(links, pairs), "key")
        lex = materialize(words.select("block", "code", "key").join(whole, "key").drop("key"), "align-lexicon")
        discard(entries, pairs)
    out = ", ".join([f"doc_id {name}", *(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256 string", *(["groups string"] if groups else [])])
    own = blocks.select("block", "ids", "sizes", "codes").groupBy("block")
    return own.cogroup(lex.groupBy("block")).applyInArrow(_assemble(kind, groups), out)


def op12_tokenizer_alignment(spark, sf_dir) -> DataFrame:
    return align_texts(table(spark, sf_dir, "documents"))
