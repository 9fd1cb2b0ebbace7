"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns give the base spans. The field has a variable for every word with a digit or an at
sign (other words are plain text for certain); its labels are none, the four kinds, and secrets (keys, tokens
and passwords, of which a pattern knows those that are assigned to a telling name). Neighbouring
variables share a chain potential; words of one document that are equal, or equal up to
punctuation and case, are each joined by a skip edge to one hub variable, which takes the kind that a
pattern knows of any of them, so the kind is one edge from all other places. Loopy message passing runs
on all documents of a batch at once, on each until its messages settle; words inside base spans are
observed. Neighbouring words whose marginals for one kind reach ``SURE`` become one additional span, if it has
the digits or the sign that its kind can't be without.

The field is trained piecewise in numpy, on the patterns' spans as labels, over at most ``SAMPLE`` documents of
at most ``LONGEST`` bytes, drawn by a digest of id and text: a softmax for the words' own shape, smoothed log-odds of label
pairs for chain edges, and one log-odds of equal against unequal labels for skip edges. As few documents repeat such words,
training also reads each document once more with altered copies of its base spans behind it, whose signs are others. A number that is long enough for a card
and fails only the check digit teaches nothing, rather than that it is none. Everything else covers
all words of all texts.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated results;
without any document the field knows only the base spans.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import slices

KINDS = ("email", "ip", "card", "phone")
#: The kinds of base spans, and what the field adds to them.
ALL = (*KINDS, "secret")
SAMPLE = 4000
#: Bytes of the longest text that the fit reads, so that the driver holds at most SAMPLE times as many.
LONGEST = 1 << 17
SURE = 0.95
#: Messages have settled when none changes by more than this; a document whose messages swing stops after ROUNDS.
SETTLED = 1e-3
ROUNDS = 1000
#: Letters and digits that words need to be joined by skip edges unless they hold four groups of digits.
SAME = 7
FEATURES = 96
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits, so the search is linear in the text
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
HINT = re.compile(r"[0-9@]")
GROUPS = re.compile(r"[0-9]+")
#: A value of eight characters or more that is assigned to a telling name; fixed values.
NAMED = re.compile(r"""(?i)\b(?:[a-z0-9_-]*(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key))["']?\s{0,4}[:=]\s{0,4}["']?([^\s"']{8,})""")
#: What a span added by the field drops at its ends.
EDGE = " \t\n\r\x0b\x0c.,;:!?*#$%&'\"<>[]{}"
#: Digits that a span can't be without, and the most that words are joined to, by kind; the other kinds are one word each.
LEAST = {2: 12, 3: 7}
MOST = {2: 19, 3: 15}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str):
    """(start, end, kind) of the patterns, by start, then kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        last = m.end() if m else at + 1
        if m:
            out.append((start, m.end(), 0))
        at = text.find("@", last)
    if HINT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _same(word: str) -> str | None:
    """What words that are joined have in common; None where a word is too short to be told from others."""
    flat = "".join(c for c in word.lower() if c.isalnum())
    if len(flat) >= SAME:
        return flat
    groups = GROUPS.findall(word)
    return ".".join(groups) if len(groups) >= 4 else None


def secrets(text: str):
    """(start, end, 4) of values that are assigned to a telling name."""
    if "=" not in text and ":" not in text:
        return []
    return [(*m.span(1), 4) for m in NAMED.finditer(text) if HINT.search(m[1])]


def _shape(word: str, before: str) -> list[int]:
    """Numbers of the features that hold of a word."""
    digits = sum(c.isdigit() for c in word)
    alpha = sum(c.isalpha() for c in word)
    flat = "".join(c for c in word if c.isalnum()).lower()
    f = [0, 1 + min(digits, 20), 22 + min(alpha, 8), 31 + min(word.count("."), 4), 36 + min(word.count("-"), 4)]
    f += [41 + k for k, hold in enumerate(("@" in word, word[:1] == "+", "(" in word, "." in word.partition("@")[2], word.isdigit(), before[-1:].isdigit(), before[-1:] in (":", "="))) if hold]
    if word.count(".") == 3 and all(p.isdigit() and len(p) <= 3 for p in word.strip(EDGE).split(".")):
        f.append(50)
    if digits and alpha and len(flat) >= 16:
        f += [51 + min(len(flat) // 8, 8), 60 + all(c in "0123456789abcdef" for c in flat)]
    if flat.isdigit():
        f.append(62 + min(len(flat), 20))
    return f


def _unproved(word: str) -> bool:
    """Long enough for a card, but for the check digit."""
    flat = word.strip(EDGE).replace("-", "")
    return flat.isdigit() and 13 <= len(flat) <= 19 and not _luhn(flat)


class Nodes:
    """Variables of a batch of texts: words with a hint, their features, edges, and labels known from base spans."""

    def __init__(self, texts, bases):
        self.doc, self.span, self.known, self.silent, features, chain, skip, hub = [], [], [], [], [], [], [], []
        self.hubs = 0
        for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
            if not HINT.search(text):
                continue
            base = sorted(base + secrets(text))
            last: dict[str, int] = {}
            centre: dict[str, int] = {}
            before, at, near = "", 0, None
            for m in TOKEN.finditer(text):
                word = m[0]
                if not HINT.search(word):
                    before, near = word, None
                    continue
                i = len(self.doc)
                while at < len(base) and base[at][1] <= m.start():
                    at += 1
                over, j = None, at
                while over is None and j < len(base) and base[j][0] < m.end():
                    over = base[j][2] if base[j][1] > m.start() else None
                    j += 1
                self.doc.append(d)
                self.span.append((m.start(), m.end()))
                self.known.append(-1 if over is None else over + 1)
                self.silent.append(over is None and _unproved(word))
                features.append(_shape(word, before))
                if near is not None:
                    chain.append((near, i))
                same = _same(word)
                if same is not None:
                    if same in last:
                        if same not in centre:
                            centre[same] = self.hubs
                            self.hubs += 1
                            hub.append((last[same], centre[same]))
                        skip.append((last[same], i))
                        hub.append((i, centre[same]))
                    last[same] = i
                before, near = word, i
        self.known = np.array(self.known, np.int64)
        self.owner = np.repeat(np.arange(len(features)), [len(f) for f in features]) if features else np.zeros(0, np.int64)
        self.feature = np.array([x for f in features for x in f], np.int64)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        #: neighbouring occurrences, which the potential is counted on, and (occurrence, hub), which messages pass along
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        self.hub = np.array(hub, np.int64).reshape(-1, 2)

    def unary(self, weights):
        out = np.zeros((len(self.known), weights.shape[1]))
        np.add.at(out, self.owner, weights[self.feature])
        return out


def _soft(x):
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def altered(text: str):
    """(text, spans): the text and, behind it, its one-word base spans with other signs between their letters and digits; the spans of both."""
    spans = base_spans(text)
    out, more = text, []
    for sign in "-/":
        for s, e, k in spans:
            word = text[s:e]
            new = re.sub(r"[^0-9A-Za-z@]", sign, word)
            if new != word and not TOKEN.sub("", word):
                more.append((len(out) + 5, len(out) + 5 + len(new), k))
                out += f"\nsee {new} too"
    return out, sorted(spans + more)


class Field:
    def __init__(self, weights, chain, skip):
        self.weights, self.chain, self.skip = weights, chain, skip

    @classmethod
    def fit(cls, texts, steps: int = 300, rate: float = 0.5):
        labels = len(ALL) + 1
        twice = [(t, base_spans(t)) for t in texts] + [altered(t) for t in texts]
        nodes = Nodes([t for t, _ in twice], [b for _, b in twice])
        y = np.maximum(nodes.known, 0)
        w = np.zeros((FEATURES, labels))
        if not len(y):
            return cls(w, np.zeros((labels, labels)), np.zeros((labels, labels)))
        square = np.full_like(w, 1e-6)
        heard = ~np.array(nodes.silent)
        for _ in range(steps):
            p = _soft(nodes.unary(w))
            p[np.arange(len(y)), y] -= 1
            p *= heard[:, None]
            g = 1e-4 * w
            np.add.at(g, nodes.feature, p[nodes.owner] / len(y))
            square += g * g
            w -= rate * g / np.sqrt(square)
        share = np.bincount(y, minlength=labels) + 1.0

        def pairs(edges):
            n = np.ones((labels, labels))
            np.add.at(n, (y[edges[:, 0]], y[edges[:, 1]]), 1.0)
            n = (n + n.T) / 2
            return np.clip(np.log(n / n.sum()) - np.log(np.outer(share, share) / share.sum() ** 2), -3, 3)

        told = nodes.skip[heard[nodes.skip].all(axis=1)]
        equal = int((y[told[:, 0]] == y[told[:, 1]]).sum())
        bond = np.log((equal + 1) / (len(told) - equal + 1))
        return cls(w, pairs(nodes.chain[heard[nodes.chain].all(axis=1)]), bond * np.eye(labels))

    def marginals(self, nodes: Nodes, rounds: int = ROUNDS) -> np.ndarray:
        """Beliefs of all words after loopy message passing along chain edges and to and from hubs."""
        n = len(nodes.known)
        u = np.concatenate([nodes.unary(self.weights), np.zeros((nodes.hubs, self.weights.shape[1]))])
        seen = np.flatnonzero(nodes.known > 0)
        u[seen] = -30.0
        u[seen, nodes.known[seen]] = 30.0
        spoke = nodes.hub + [0, n]
        told = spoke[nodes.known[spoke[:, 0]] > 0]
        u[np.unique(told[:, 1])] = -1e6  # beyond what any number of places can say against it
        u[told[:, 1], nodes.known[told[:, 0]]] = 1e6
        edges = np.concatenate([nodes.chain, spoke])
        if not len(edges):
            return _soft(u[:n])
        psi = np.concatenate([np.broadcast_to(self.chain, (len(nodes.chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(spoke), *self.skip.shape))])
        # a document whose messages have settled is left out of further rounds, so its result doesn't depend on the batch
        doc = np.array(nodes.doc, np.int64)[edges[:, 0]]
        m = np.zeros((2, len(edges), u.shape[1]))
        live, busy = np.arange(len(edges)), np.zeros(int(doc.max()) + 1, bool)
        for _ in range(rounds):
            a, b, p, now = edges[live, 0], edges[live, 1], psi[live], m[:, live]
            belief = u.copy()
            np.add.at(belief, b, now[0])
            np.add.at(belief, a, now[1])
            new = np.stack([np.logaddexp.reduce((belief[a] - now[1])[:, :, None] + p, axis=1), np.logaddexp.reduce((belief[b] - now[0])[:, :, None] + p.transpose(0, 2, 1), axis=1)])
            new -= new.max(axis=2, keepdims=True)
            new = 0.5 * now + 0.5 * new
            m[:, live] = new
            busy[:] = False
            busy[doc[live[(np.abs(new - now) > SETTLED).any(axis=(0, 2))]]] = True
            live = live[busy[doc[live]]]
            if not len(live):
                break
        np.add.at(u, edges[:, 1], m[0])
        np.add.at(u, edges[:, 0], m[1])
        return _soft(u[:n])

    def find(self, texts):
        """(base spans, additional spans) of each text."""
        bases = [base_spans(t) for t in texts]
        more = [secrets(t) for t in texts]
        nodes = Nodes(texts, bases)
        if len(nodes.known):
            p = self.marginals(nodes)
            best = np.where((nodes.known < 0) & (p.max(axis=1) >= SURE), p.argmax(axis=1), 0)
            after = dict(nodes.chain.tolist())
            done = -1
            for i in np.flatnonzero(best > 0).tolist():
                if i <= done:
                    continue
                done, d, kind = i, nodes.doc[i], int(best[i]) - 1
                start, end = nodes.span[i]
                while kind in MOST and best[after.get(done, -1)] == best[i] and done in after:
                    if sum(c.isdigit() for c in texts[d][start : nodes.span[after[done]][1]]) > MOST[kind]:
                        break
                    done = after[done]
                    end = nodes.span[done][1]
                part = texts[d][start:end]
                start += len(part) - len(part.lstrip(EDGE))
                part = part.strip(EDGE)
                if sum(c.isdigit() for c in part) >= LEAST.get(kind, 1) or (kind == 0 and "@" in part):
                    more[d].append((start, start + len(part), kind))
        return bases, more


def spell(spans) -> str:
    return ",".join(f"{ALL[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def fit(docs: DataFrame, id_col="doc_id", text_col="text", sample: int = SAMPLE) -> Field:
    """Field trained on at most sample documents that have a digit or an at sign, drawn by a digest of the id."""
    near = docs.where(F.col(text_col).rlike("[0-9@]") & (F.octet_length(F.col(text_col).cast("string")) <= LONGEST))
    rows = near.select(F.xxhash64(F.lit("pii"), F.col(id_col), F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    drawn = rows.select("mark").distinct().orderBy("mark").limit(sample)
    got = rows.join(F.broadcast(drawn), "mark", "left_semi").dropDuplicates(["mark"])  # at most sample rows
    return Field.fit([r["text"] for r in sorted(got.toLocalIterator(), key=lambda r: r["mark"])])


def find_pii(docs: DataFrame, field: Field, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, base, added): arrays of (kind, begin, end), ends exclusive, in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a few tables of fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                base, more = sent.value.find([x or "" for x in part.column("text").to_pylist()])
                cols = [pa.array([[{"kind": ALL[k], "begin": s, "end": e} for s, e, k in d] for d in side], span) for side in (base, more)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "base", "added"])

    s = "array<struct<kind:string,begin:int,end:int>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, base {s}, added {s}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and spellings of base and all spans."""
    kinds = F.array(*[F.lit(k) for k in ALL])

    def spelled(spans):
        rows = F.array_sort(F.transform(spans, lambda x: F.struct(x["begin"].alias("s"), F.array_position(kinds, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("n"))))
        return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["n"], r["s"], r["e"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.concat("base", "added")).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op8_pii(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(find_pii(docs, fit(docs)))
