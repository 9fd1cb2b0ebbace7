"""Removal of repeated byte strings, ordered by deep-shallow suffix sorting.

A byte goes when a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller
id. Only suffixes whose first LENGTH bytes can occur twice are sorted:

1. Every string of LENGTH bytes has a minimizer, its least hashed gram of ``GRAM`` bytes (leftmost on
   ties). Equal strings have equal minimizers, so the text's grams that are minimizers are
   exchanged by hash, once a batch each, and those found in two different texts come back.
2. Strings with a repeated minimizer are gathered by its hash as runs of bytes (neighbouring strings
   share one), equal runs of one pack of texts only once.
3. In each part the suffixes that begin these strings are sorted by deep-shallow sorting: multikey
   quicksort on eight-byte symbols to a shallow depth, then blind tries part the groups whose common
   prefix is longer. Strings of one class start in all documents of that class; all but those of
   its smallest id are repeats.
4. The repeats go back to their texts, where the covered bytes are cut.

Grams only decide what is compared; matches are of whole bytes. Of equal texts, the one of the smallest
id alone is compared; the others lose everything, which a join by digest settles. Texts whose copies hold more than
one part in ``HOT_PARTS`` of all bytes leave but that one row before texts are dealt out, and a batch deals
each text once, so no pack gathers a large group. A gram in most texts is sent once a batch, a run in most texts
once a pack. Texts and runs travel compressed.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing; a null id comes
after all others; rows of one id never shorten each other; repeated rows keep a row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table, text_bytes
from .tokens import slices

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
HOT_PARTS = 1 << 18
#: Distinct texts of a batch that send a gram each in their own name; beyond, it is known to repeat.
FEW = 8
#: Text bytes in a pack, and behind a part of the exchange of grams, that the numbers of packs and parts aim at.
PACK_BYTES = 4 << 20
PART_BYTES = 16 << 20
#: Parts that what batches know about the texts of one pack is spread over.
SPREAD = 16
PIECE = 2 << 20
LAST = np.iinfo(np.int64).max


def pieces(texts: list[bytes], limit: int = PIECE):
    """Groups of (text number, first byte, bytes) with about limit bytes each; long texts are cut with an overlap, so no string is lost."""
    out, held = [], 0
    for i, x in enumerate(texts):
        if len(x) < LENGTH:
            continue
        for a in range(0, len(x) - LENGTH + 1, limit):
            part = x[a : a + limit + LENGTH - 1]
            if held and held + len(part) > limit:
                yield out
                out, held = [], 0
            out.append((i, a, part))
            held += len(part)
    if out:
        yield out


def minimizers(group):
    """Runs of strings with one minimizer: (hash of the minimizer, piece number, first string's byte, number of strings), and the bytes joined."""
    data = np.frombuffer(b"".join(x for _, _, x in group), np.uint8)
    size = np.array([len(x) for _, _, x in group])
    begin = np.cumsum(size) - size
    h = data.astype(np.uint64)
    for k in (1, 2, 4):  # hashes of 2, 4, 8 bytes
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15 ^ k) + h[k:]
        h ^= h >> np.uint64(29)
    h16 = h[:-8] * np.uint64(0xBF58476D1CE4E5B9) + h[8:]
    h = h16[:-8] * np.uint64(0x94D049BB133111EB) + h[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    m = low
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:])
    m = np.minimum(m[: len(m) - (SPAN - 16)], m[SPAN - 16 :])
    piece = np.repeat(np.arange(len(group)), size - LENGTH + 1)
    first = np.arange(len(piece)) - np.repeat(np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1), size - LENGTH + 1) + begin[piece]
    at = (m[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
    n = np.diff(head, append=len(at))
    return h[at[head]], piece[head], first[head], n, data


def _key(h: np.ndarray, parts: int):
    """Part of a gram, and the 32 bits that stand for it there; grams that share both are compared in vain, but not taken for equal."""
    return (h % np.uint64(parts)).astype(np.int64), h >> np.uint64(32)


def _small(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True)


def _whole(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _cuts(*columns):
    """Bounds of the runs of equal values in sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(change)
    return begin, np.append(begin[1:], n)


def _exchange(parts: int, packs: int):
    """Step 1, sending: rows (part, texts, counts, grams). Grams that a batch finds to repeat go straight to their texts' packs, in parts below 0."""
    schema = pa.schema([("part", pa.int64()), ("texts", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 * PIECE):
                own = list(dict.fromkeys(x for x in part.column("text").cast(pa.binary()).to_pylist() if x and len(x) >= LENGTH))
                ids = np.array([xxhash.xxh64_intdigest(x, 42) for x in own], np.uint64).view(np.int64)
                hs, ts = [], []
                for group in pieces(own):
                    h, piece, *_ = minimizers(group)
                    hs.append(h)
                    ts.append(np.array([i for i, _, _ in group])[piece])
                if not hs:
                    continue
                h, t = np.concatenate(hs), np.concatenate(ts)
                order = np.lexsort((t, h))
                h, t = h[order], t[order]
                one = np.ones(len(h), bool)
                one[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                h, t = h[one], t[one]
                a, b = _cuts(h)
                many = np.repeat(b - a > FEW, b - a)
                q, short = _key(h, parts)
                rows = []
                if many.any():
                    who, gram = ids[t[many]], (short[many] * np.uint64(parts) + q[many].astype(np.uint64)).view(np.int64)
                    pack = np.mod(who, packs)
                    order = np.argsort(pack, kind="stable")
                    who, gram, pack = who[order], gram[order], pack[order]
                    for x, y in zip(*_cuts(pack), strict=True):
                        rows.append((-1 - (int(pack[x]) * SPREAD + int(ids[0]) % SPREAD), who[x:y].astype("<i8").tobytes(), b"", gram[x:y].astype("<i8").tobytes()))
                keep = ~many
                keep[a[b - a > FEW]] = True
                t = np.where(many, -1, t)[keep]
                q, short = q[keep], short[keep]
                order = np.lexsort((t, q))
                q, t, short = q[order], t[order], short[order]
                for x, y in zip(*_cuts(q), strict=True):
                    c, d = _cuts(t[x:y])
                    who = t[x:y][c]
                    rows.append((int(q[x]), np.where(who < 0, -1, ids[who]).astype("<i8").tobytes(), (d - c).astype("<u4").tobytes(), short[x:y].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run, "part long, texts binary, counts binary, grams binary"


def _meet(parts: int, packs: int):
    """Step 1, meeting: grams found in two texts go back to each, as (pack, texts, grams)."""

    def run(key, t):
        q = key[0].as_py()
        texts = np.frombuffer(b"".join(t.column("texts").to_pylist()), "<i8")
        if q < 0:
            gram = np.frombuffer(b"".join(t.column("grams").to_pylist()), "<i8")
            order = np.lexsort((gram, texts))
            first, _ = _cuts(texts[order], gram[order])
            return _deal(texts[order][first], gram[order][first], packs)
        counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), "<u4")
        h = np.frombuffer(b"".join(t.column("grams").to_pylist()), "<u4").astype(np.uint64)
        who = np.repeat(texts, counts)
        order = np.lexsort((who, h))
        h, who = h[order], who[order]
        begin, end = _cuts(h)
        twice = (who[begin] != who[end - 1]) | (who[begin] == -1)
        pick = np.repeat(twice, end - begin) & (who != -1)
        return _deal(who[pick], (h[pick] * np.uint64(parts) + np.uint64(q)).view(np.int64), packs)

    return run


def _deal(who, gram, packs):
    pack = np.mod(who, packs)
    order = np.argsort(pack, kind="stable")
    pack, who, gram = pack[order], who[order], gram[order]
    a, b = _cuts(pack)
    return pa.table({"pack": pa.array(pack[a], pa.int32()), "texts": pa.array([who[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()), "grams": pa.array([gram[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())})


def _send(packs: int):
    """Deals texts into packs, those of a batch once each with their smallest id, as rows (pack, ids, sizes, texts)."""
    schema = pa.schema([("pack", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 * PIECE):
                least: dict[bytes, int] = {}
                for d, x in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    d = LAST if d is None else d
                    if d < least.get(x, LAST + 1):
                        least[x] = d
                by: dict[int, list] = {}
                pack = np.mod(np.array([xxhash.xxh64_intdigest(x, 42) for x in least], np.uint64).view(np.int64), packs)
                for k, (x, d) in zip(pack.tolist(), least.items(), strict=True):
                    by.setdefault(k, []).append((d, x))
                rows = [(k, np.array([d for d, _ in v], "<i8").tobytes(), np.array([len(x) for _, x in v], "<i8").tobytes(), _small(b"".join(x for _, x in v))) for k, v in by.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run, "pack int, ids binary, sizes binary, texts binary"


def _firsts(t: pa.Table):
    """Distinct texts of a pack, and the smallest id of each."""
    least: dict[bytes, int] = {}
    for ids, sizes, texts in zip(*(t.column(c).to_pylist() for c in ("ids", "sizes", "texts")), strict=True):
        every, at = _whole(texts), 0
        for d, n in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist(), strict=True):
            x, at = every[at : at + n], at + n
            if d < least.get(x, LAST + 1):
                least[x] = d
    return list(least), np.array(list(least.values()), np.int64)


def _gather(parts: int, packs: int):
    """Step 2: runs of strings with repeated minimizers, as rows (part, head, places, runs); runs repeated inside the pack are answered at once, in a part below 0."""

    def run(key, texts, replies):
        out, dup = [], []
        own, least = _firsts(texts)
        ids = np.array([xxhash.xxh64_intdigest(x, 42) for x in own], np.uint64).view(np.int64)
        who = np.frombuffer(b"".join(replies.column("texts").to_pylist()), np.int64)
        gram = np.frombuffer(b"".join(replies.column("grams").to_pylist()), np.int64)
        called = np.isin(ids, who)
        # a gram that comes back for any text of the pack may repeat in all of them
        grams = np.unique(gram)
        runs: dict[bytes, list] = {}
        for group in pieces([x if c else b"" for x, c in zip(own, called, strict=True)]):
            h, piece, first, n, data = minimizers(group)
            q, short = _key(h, parts)
            full = (short * np.uint64(parts) + q.astype(np.uint64)).view(np.int64)
            at = np.searchsorted(grams, full)
            hit = np.flatnonzero(grams[np.minimum(at, len(grams) - 1)] == full) if len(grams) else []
            raw = data.tobytes()
            base = np.cumsum([0] + [len(x) for _, _, x in group])
            for j in hit:
                i, a, _ = group[piece[j]]
                s = int(first[j])
                runs.setdefault(raw[s : s + int(n[j]) + LENGTH - 1], [int(h[j] % np.uint64(packs))]).append((int(least[i]), i, a + s - int(base[piece[j]])))
        by: dict[int, list] = {}
        for x, (q, *seen) in runs.items():
            low = min(d for d, _, _ in seen)
            n = len(x) - LENGTH + 1
            dup += [(int(ids[i]), d, s, n) for d, i, s in seen if d > low]
            mine = [(i, s) for d, i, s in seen if d == low]
            by.setdefault(q, []).append((x, low, [(int(ids[i]), s) for i, s in mine]))
        for q, items in by.items():
            head, where = [], []
            for x, low, mine in items:
                head.append((low, len(x), len(mine)))
                where += mine
            out.append((q, np.array(head, "<i8").tobytes(), np.array(where, "<i8").tobytes(), _small(b"".join(x for x, _, _ in items))))
        if dup:
            out.append((-1 - key[0].as_py(), np.array(dup, "<i8").tobytes(), b"", b""))
        return pa.table({"part": pa.array([o[0] for o in out], pa.int64()), "head": pa.array([o[1] for o in out], pa.binary()), "places": pa.array([o[2] for o in out], pa.binary()), "runs": pa.array([o[3] for o in out], pa.binary())})

    return run


def symbols(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number in byte order."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | pad[k : k + len(data)]
    return out


#: Symbols of eight bytes that multikey quicksort reads before blind tries take over.
SHALLOW = 2


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW):
    """Order of the suffixes at starts by their first length bytes, and the class of equal ones: (order, class of each in that order)."""
    eight = symbols(data)
    depth = [*range(0, length - 8, 8), length - 8]  # the last symbol overlaps the one before
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    todo = order
    for d in depth[:shallow]:  # multikey quicksort: groups are parted by one symbol at a time
        if not len(todo):
            break
        sym = eight[starts[todo] + d]
        by = np.lexsort((sym, group[todo]))
        todo, sym = todo[by], sym[by]
        g = group[todo]
        a, b = _cuts(g, sym)
        new = np.repeat(a, b - a)
        begin, end = _cuts(g)
        group[todo] = new - np.repeat(begin, end - begin) + g
        todo = todo[np.repeat(b - a > 1, b - a)]
    # blind tries: each group's first suffix is the spine; the others leave it where they first differ, by the byte found there
    rest = depth[shallow:]
    while len(todo) and rest:
        by = np.argsort(group[todo], kind="stable")
        todo = todo[by]
        a, b = _cuts(group[todo])
        spine = np.repeat(todo[a], b - a)
        leave = np.full(len(todo), length, np.int64)
        diff = np.zeros(len(todo), np.uint64)
        open_ = np.arange(len(todo))
        for d in rest:
            x = eight[starts[todo[open_]] + d] ^ eight[starts[spine[open_]] + d]
            off = x != 0
            at = open_[off]
            diff[at] = x[off]
            lead = 7 - (np.frexp(x[off].astype(np.float64))[1] - 1) // 8
            # rounding to a double may carry into the next byte
            lead = np.where((lead < 7) & ((x[off] >> (np.uint64(8) * (7 - np.maximum(lead, 0)).astype(np.uint64))) == 0), lead + 1, np.maximum(lead, 0))
            leave[at] = d + lead
            open_ = open_[~off]
        alone = leave == length
        byte = np.where(alone, 0, data[np.minimum(starts[todo] + leave, len(data) - 1)]).astype(np.int64)
        over = np.where(alone, 0, np.where(byte > data[np.minimum(starts[spine] + leave, len(data) - 1)], 1, -1))
        # below the spine, an early leaver comes first; above it, last
        place = np.where(over < 0, leave, np.where(over > 0, 3 * length - leave, length + 1))
        by = np.lexsort((byte, place, group[todo]))
        todo, place, byte, alone = todo[by], place[by], byte[by], alone[by]
        g = group[todo]
        a, b = _cuts(g, place, byte)
        new = np.repeat(a, b - a)
        begin, end = _cuts(g)
        group[todo] = new - np.repeat(begin, end - begin) + g
        todo = todo[np.repeat(b - a > 1, b - a) & ~alone]
    order = np.argsort(group, kind="stable")
    return order, group[order]


def _sort(packs: int):
    """Step 3: the strings of a part that also start in a document with a smaller id, as rows (pack, places)."""

    def run(key, t):
        if key[0].as_py() < 0:
            found = [np.frombuffer(x, "<i8").reshape(-1, 4) for x in t.column("head").to_pylist()]
            return _ranges(np.concatenate(found), packs)
        head = np.frombuffer(b"".join(t.column("head").to_pylist()), "<i8").reshape(-1, 3)
        places = np.frombuffer(b"".join(t.column("places").to_pylist()), "<i8").reshape(-1, 2)
        data = np.frombuffer(b"".join(map(_whole, t.column("runs").to_pylist())), np.uint8)
        low, size, n = head[:, 0], head[:, 1], head[:, 2]
        strings = size - LENGTH + 1
        run_ = np.repeat(np.arange(len(head)), strings)
        offset = np.arange(len(run_)) - np.repeat(np.cumsum(strings) - strings, strings)
        starts = (np.cumsum(size) - size)[run_] + offset
        order, group = deep_shallow(data, starts)
        if not len(order):
            return _ranges(np.zeros((0, 4), np.int64), packs)
        a, b = _cuts(group)
        first = np.minimum.reduceat(low[run_[order]], a)
        late = np.zeros(len(order), bool)
        late[order] = low[run_[order]] > np.repeat(first, b - a)
        # neighbouring repeats of a run make one range
        at = np.flatnonzero(late)
        if not len(at):
            return _ranges(np.zeros((0, 4), np.int64), packs)
        cut = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        cut = np.unique(np.concatenate([cut, np.flatnonzero(np.diff(run_[at], prepend=-1) != 0)]))
        width = np.diff(cut, append=len(at))
        r, off = run_[at[cut]], offset[at[cut]]
        begin = np.cumsum(n) - n
        i = np.repeat(np.arange(len(r)), n[r])
        p = np.arange(len(i)) - np.repeat(np.cumsum(n[r]) - n[r], n[r]) + begin[r][i]
        return _ranges(np.stack([places[p, 0], low[r][i], places[p, 1] + off[i], width[i]], axis=1), packs)

    return run


def _ranges(x: np.ndarray, packs: int) -> pa.Table:
    pack = np.mod(x[:, 0], packs)
    order = np.argsort(pack, kind="stable")
    x, pack = x[order], pack[order]
    a, b = _cuts(pack)
    return pa.table({"pack": pa.array(pack[a], pa.int32()), "ranges": pa.array([x[i:j].astype("<i8").tobytes() for i, j in zip(a, b, strict=True)], pa.binary())})


def _cut(key, texts, found):
    """Step 4: rows of the documents that lose bytes."""
    own, least = _firsts(texts)
    ids: dict[int, list[int]] = {}
    for i, x in enumerate(own):
        ids.setdefault(xxhash.xxh64_intdigest(x, 42), []).append(i)
    marks = np.frombuffer(b"".join(found.column("ranges").to_pylist()), "<i8").reshape(-1, 4)
    spans: dict[int, list] = {}
    for t, low, s, n in marks.tolist():
        for i in ids.get(t & (2**64 - 1), ()):
            if least[i] == low:
                spans.setdefault(i, []).append((s, s + n + LENGTH - 1))
    cut: dict[int, tuple] = {}
    for i, ranges in spans.items():
        x, kept, at, runs = own[i], [], 0, 0
        end = -1
        for a, b in sorted(ranges):
            if a > end:
                runs += 1
                kept.append(x[at:a])
            end = max(end, b)
            at = end
        kept.append(x[at:])
        left = b"".join(kept)
        cut[i] = (len(x) - len(left), runs, hashlib.sha256(left).hexdigest(), left)
    cols = list(zip(*[(None if least[i] == LAST else int(least[i]), xxhash.xxh64_intdigest(own[i], 42), *x) for i, x in cut.items()], strict=True)) or [()] * 6
    signed = np.array(cols[1], np.uint64).view(np.int64)
    return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "t": pa.array(signed), "n_removed": pa.array(cols[2], pa.int64()), "n_spans": pa.array(cols[3], pa.int64()), "kept_sha256": pa.array(cols[4], pa.string()), "kept": pa.array(cols[5], pa.binary())})


def suffix_dedup(docs: DataFrame, id_col="doc_id", text_col="text", texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept (the remaining bytes)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = materialize(base.select("doc_id", F.xxhash64("text").alias("t"), F.sha2("text", 256).alias("s"), text_bytes(F.col("text")).alias("n_bytes")), "suffix-rows")
    total = rows.agg(F.sum("n_bytes")).head()[0] or 0
    packs, parts = (max(48, total // n) for n in (PACK_BYTES, PART_BYTES))
    part = rows.groupBy("s", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.min("t").alias("hot_t"), F.sum("n_bytes").alias("bytes"))
    groups = materialize(part.groupBy("s").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min("hot_t").alias("hot_t"), F.sum("bytes").alias("bytes")).where("n > 1 and first is not null"), "suffix-copies")
    is_hot = F.col("bytes") > max(PACK_BYTES // 16, total // HOT_PARTS)
    hot = materialize(groups.where(is_hot), "suffix-hot")  # at most HOT_PARTS rows, since each stands for more than that part of the bytes
    send, kind = _exchange(parts, packs)
    replies = base.select("text").mapInArrow(send, kind).groupBy("part").applyInArrow(_meet(parts, packs), "pack int, texts binary, grams binary")
    replies = materialize(replies, "suffix-replies")
    # of hot copies only the first goes on; the others lose everything
    long = base.where(F.octet_length("text") >= LENGTH).withColumn("t", F.xxhash64("text"))
    cold = long.join(F.broadcast(hot.select("hot_t", "first").dropDuplicates(["hot_t"])), F.col("t") == F.col("hot_t"), "left").where("first is null or doc_id = first")
    deal, kind = _send(packs)
    cold = cold.select("doc_id", "text").mapInArrow(deal, kind)
    gathered = cold.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(_gather(parts, packs), "part long, head binary, places binary, runs binary")
    found = materialize(gathered.groupBy("part").applyInArrow(_sort(packs), "pack int, ranges binary"), "suffix-ranges")
    discard(replies)
    lost = cold.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(_cut, "doc_id long, t long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not texts:
        lost = lost.drop("kept")
    lost = lost.withColumnsRenamed({"doc_id": "d", "t": "u", "n_removed": "r", "n_spans": "k", "kept_sha256": "left"})
    # copies lose everything: of hot groups by broadcast, of the others by a join
    cool = groups.where(~is_hot).select("s", F.col("first").alias("f2"))
    out = rows.join(F.broadcast(hot.select("s", F.col("first").alias("f1"))), "s", "left").join(cool, "s", "left")
    out = out.withColumn("first", F.coalesce("f1", "f2")).join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left")
    copy = F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("n_bytes") >= LENGTH)
    cols = [
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("k", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left", "s")).alias("kept_sha256"),
    ]
    if texts:
        cols.append(F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))  # null where nothing goes
    return out.select(*cols)


def op10_suffix_dedup(spark, sf_dir) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


#: Every string of fifty bytes, as hexadecimal digits; texts are cut into chunks that overlap, so that cutting one string is cheap.
SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), p AS (
  SELECT doc_id, n, c * 1000 AS a, substr(h, 2000 * c + 1, 2098) AS h FROM d, LATERAL (SELECT unnest(range(0, greatest((n + 950) // 1000, 0))) AS c) WHERE n >= 50
), w AS (
  SELECT doc_id, a + i AS pos, substr(h, 2 * i + 1, 100) AS s FROM p, LATERAL (SELECT unnest(range(0, least(1000, length(h) // 2 - 49))) AS i)
), m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (s) WHERE doc_id > low),
g AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM r),
x AS (SELECT doc_id, k, min(pos) AS a, max(pos) + 50 AS b FROM g GROUP BY ALL),
y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM x),
k AS (
  SELECT y.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM y JOIN d USING (doc_id) GROUP BY 1
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
