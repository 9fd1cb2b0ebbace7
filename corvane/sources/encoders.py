"""Encoders: text to vectors, by a template, a model's token states, and a pooling.

A model is any function from a list of texts to (states, mask), arrays of (texts, tokens, dims) and (texts, tokens); a
model that gives all its layers returns states as (layers, texts, tokens, dims), of which an encoder takes its own. It is
called on batches in Arrow workers, once for all layers and poolings that are asked for together. Where no model is given, token states are made from digests of the words,
which has no meaning but all the structure: states differ by layer, depend on the word before, and are pooled like
any other. ``digest_states`` gives them as an expression; ``digest_vectors`` pools them in Arrow workers, which take the
digest of a word once for many texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TEMPLATES, templated
from ..functions.vectors import let

#: Tokens that a text is cut off after, as in the protocols.
LIMIT = 128
BATCH = 64
DIM = 16


def digest_states(text: Column, layer: int = 0, limit: int = LIMIT, dim: int = DIM) -> Column:
    """array<struct<pos, mask, h>>: the state of a word is its digest's bytes, scaled to -1..1, and half those of the word before."""
    words = F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, limit)

    def state(w):
        digest = F.md5(F.concat(F.lit(f"{layer}:"), w).cast("binary"))
        byte = lambda d, j: (F.conv(F.substring(d, j * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5
        return let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: byte(d, j)))

    def mixed(own):
        # the words before, beside the words
        before = F.slice(F.concat(F.array(F.array_repeat(F.lit(0.0), dim)), own), F.lit(1), F.size(own))
        both = F.zip_with(own, before, lambda h, b: F.zip_with(h, b, lambda x, y: x + y * 0.5))
        return F.transform(both, lambda h, i: F.struct(i.alias("pos"), F.lit(1).alias("mask"), h.alias("h")))

    return let(F.transform(words, state), mixed)


#: Distinct words whose states a worker remembers.
REMEMBERED = 1 << 16


def digest_vectors(outputs: list[tuple[int, str]], template: str, limit: int = LIMIT):
    """A function from texts to unit vectors, (texts, dims) for each output (layer, pooling), of the states of ``digest_states``; and which texts have a word."""
    layers = list(dict.fromkeys(layer for layer, _ in outputs))
    rows: dict[bytes, int] = {}
    digests: dict[int, list[bytes]] = {layer: [] for layer in layers}

    def run(texts):
        words = [[] if t is None else template.replace("{sentence}", t).encode().split(None, limit)[:limit] for t in texts]  # bytes are split at the same six characters
        size = np.array([len(w) for w in words])
        full = size > 0
        ends = np.cumsum(size)[full]
        begins = ends - size[full]
        flat = [w for x in words for w in x]
        if len(rows) > REMEMBERED:
            rows.clear()
            digests.update({layer: [] for layer in layers})
        for w in set(flat).difference(rows):
            rows[w] = len(rows)
            for layer in layers:
                digests[layer].append(hashlib.md5(b"%d:" % layer + w).digest())
        codes = np.fromiter(map(rows.__getitem__, flat), np.int64, len(flat))
        out = {}
        for layer in layers:
            own = ((np.frombuffer(b"".join(digests[layer]), np.uint8) - 127.5) / 127.5).reshape(-1, DIM)[codes]
            before = np.zeros_like(own)
            before[1:] = own[:-1]
            before[begins] = 0
            h = own + before * 0.5
            for pool in (p for at, p in outputs if at == layer):
                if pool == "mean":
                    v = (np.add.reduceat(h, begins, axis=0) if len(begins) else h) / size[full][:, None]
                else:
                    v = h[np.maximum(ends - {"last": 1, "second_last": 2}[pool], begins)]
                out[layer, pool] = v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-12)
        return out, np.flatnonzero(full)

    return run


def pooled(states: np.ndarray, mask: np.ndarray, pool: str) -> np.ndarray:
    """One vector a text, of states whose padding is on the right."""
    if pool == "mean":
        return (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
    back = {"last": 1, "second_last": 2}[pool]
    return states[np.arange(len(states)), np.maximum(mask.sum(axis=1).astype(int) - back, 0)]


@dataclass(frozen=True)
class Encoder:
    name: str = "digest"
    template: str = "Plain"
    pool: str = "mean"
    layer: int = 0
    model: Callable | None = None

    def tokens(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with the token states of its templated text; for encoders without a model."""
        return df.withColumn("tokens", digest_states(templated(TEMPLATES[self.template], text), self.layer))

    def encode(self, df: DataFrame, text: str = "text", out: str = "embedding", keep: tuple[str, ...] | None = None) -> DataFrame:
        """df, or its columns in keep, with out: unit vectors of text. A null or wordless text has a null vector."""
        kept = [c for c in (df.columns if keep is None else keep) if c != out]
        return self.encode_many(df, [(self.layer, self.pool)], text, out, missing=True, keep=kept).select(*kept, out)

    def encode_many(self, df: DataFrame, outputs: list[tuple[int, str]], text: str = "text", out: str = "embedding", missing: bool = False, keep=None) -> DataFrame:
        """df with layer, pool and out: a row for each text and output (layer, pooling), all of one pass of the model over each batch. Null and wordless texts are left out, or kept with null vectors on request."""
        names = [c for c in (df.columns if keep is None else keep) if c not in (out, "layer", "pool")]
        model, template = self.model, TEMPLATES[self.template]
        source = df.columns.index(text)
        at = [df.columns.index(c) for c in names]
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}

        def encode(texts):
            full = [i for i, t in enumerate(texts) if t and t.strip()]
            vectors: dict = {o: [] for o in outputs}
            for k in range(0, len(full), BATCH):
                states, mask = model([template.replace("{sentence}", texts[i]) for i in full[k : k + BATCH]])
                for layer, pool in outputs:
                    y = pooled(states if np.ndim(states) == 3 else states[layer], mask, pool)
                    vectors[layer, pool].extend((y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-12)).tolist())
            return vectors, full

        def run(batches):
            each = digest_vectors(outputs, template) if model is None else encode
            for b in batches:
                vectors, full = each(b.column(source).to_pylist())
                n = b.num_rows if missing else len(full)
                at_ = np.full(b.num_rows, -1)
                at_[full] = np.arange(len(full))
                place = pa.array(at_ if missing else np.arange(len(full)), pa.int64(), mask=(at_ < 0) if missing else None)
                own = [b.column(i) if missing else b.column(i).take(pa.array(full, pa.int64())) for i in at]
                for layer, pool in outputs:
                    v = vectors[layer, pool]
                    v = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * DIM, v.ravel()) if model is None else pa.array(v, pa.list_(pa.float64()))
                    v = v.take(place)
                    yield pa.RecordBatch.from_arrays([*own, pa.array([layer] * n, pa.int32()), pa.array([pool] * n, pa.string()), v], [*names, "layer", "pool", out])

        return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "layer int, pool string", f"`{out}` array<double>"]))
