"""Quality classification by a byte-level convolutional network, in numpy.

Input channels of a chunk of CHUNK bytes, every STEP bytes: an embedding of each byte (learned) and, for each lag up to
LAGS, how many of the chunk's bytes equal the byte that many places before. Learned filters look at overlapping chunks
over the whole document, are rectified and max-pooled over all of them, and a small dense layer combines the maxima into
one probability. Documents of any length are read in blocks that overlap by what a chunk and its lags look back on, and
the maxima of blocks are combined, so the result does not depend on blocks.

The network is trained here, by Adam on cross entropy, on a bounded, documented sample of labelled texts: about PER_CLASS
texts of each label, drawn by a hash of their ids; long ones are trained on in whole, as the chunk where each filter is
largest is all that a step learns from.

Defined results: a null text counts as empty; the empty text scores what the network gives for a document of zeros;
repeated rows give repeated rows, and of rows that share an id one is trained on; labels, lang, source and ids are never
inputs; without labelled documents of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesum.llm.common import lean, tidy, trim

CHUNK, STEP, LAGS, EMBED, FILTERS, HIDDEN = 16, 8, 24, 6, 24, 12
PER_CLASS, EPOCHS, BATCH = 700, 14, 48
BLOCK = 1 << 18


def chunks(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, CHUNK) bytes of each chunk and (n, LAGS) shares of equal bytes; b starts with LAGS bytes of lead."""
    n = max(1, -(-(len(b) - LAGS - CHUNK) // STEP) + 1)
    full = np.zeros(LAGS + (n - 1) * STEP + CHUNK, np.uint8)
    full[: len(b)] = b
    view = np.lib.stride_tricks.sliding_window_view(full[LAGS:], CHUNK)[::STEP]
    same = np.empty((n, LAGS), np.float32)
    halves = CHUNK // STEP
    for k in range(1, LAGS + 1):
        eq = (full[LAGS:] == full[LAGS - k : len(full) - k]).view(np.uint8)
        eq &= full[LAGS:] != 0
        part = eq[: len(eq) // STEP * STEP].reshape(-1, STEP).sum(1, dtype=np.uint8)
        same[:, k - 1] = sum(part[h : h + n].astype(np.float32) for h in range(halves))
    return view, same / np.float32(CHUNK)


def blocks(text: bytes) -> Iterator[np.ndarray]:
    """The document in blocks with lead; starts are multiples of STEP and neighbours share the chunks between them."""
    b = np.concatenate([np.zeros(LAGS, np.uint8), np.frombuffer(text, np.uint8)])
    for at in range(0, max(1, len(text)), BLOCK):
        yield b[at : at + LAGS + BLOCK + CHUNK]


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "E": r.normal(0, 0.3, (256, EMBED)).astype(f),
            "W": r.normal(0, 0.12, (CHUNK * EMBED, FILTERS)).astype(f),
            "S": r.normal(0, 0.2, (LAGS, FILTERS)).astype(f),
            "b": np.zeros(FILTERS, f),
            "H": r.normal(0, 0.3, (FILTERS, HIDDEN)).astype(f),
            "c": np.zeros(HIDDEN, f),
            "v": r.normal(0, 0.3, HIDDEN).astype(f),
            "d": np.zeros(1, f),
        }
        self.shift = 0.0
        self.constant: float | None = None

    def pool(self, text: bytes) -> np.ndarray:
        p, out = self.p, np.full(FILTERS, -np.inf, np.float32)
        for b in blocks(text):
            x, same = chunks(b)
            for lo in range(0, len(x), 1 << 13):
                z = p["E"][x[lo : lo + (1 << 13)]].reshape(-1, CHUNK * EMBED) @ p["W"] + same[lo : lo + (1 << 13)] @ p["S"]
                out = np.maximum(out, z.max(0))
        return np.maximum(out + p["b"], 0)

    def head(self, pooled: np.ndarray) -> np.ndarray:
        p = self.p
        z = np.tanh(pooled @ p["H"] + p["c"]) @ p["v"] + p["d"][0] + self.shift
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.head(np.stack([self.pool(t) for t in texts])) if texts else np.zeros(0)

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> None:
        r = np.random.default_rng(seed)
        data = [chunks(np.concatenate([np.zeros(LAGS, np.uint8), np.frombuffer(t, np.uint8)])) for t in texts]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(texts) // BATCH)
        w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                step += 1
                g = self._gradient([data[i] for i in order[lo : lo + BATCH]], y[order[lo : lo + BATCH]], w[order[lo : lo + BATCH]])
                rate = 0.01 * min(1.0, step / 20) * (0.05 + 0.95 * (1 - step / total))
                for k, v in self.p.items():
                    gk = g[k] + 1e-4 * v
                    m[k] += 0.1 * (gk - m[k])
                    s[k] += 0.01 * (gk * gk - s[k])
                    v -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def _gradient(self, data: list, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        sizes = np.array([len(x) for x, _ in data])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = np.concatenate([x for x, _ in data])
        same = np.concatenate([s for _, s in data])
        z = p["E"][x].reshape(len(x), -1) @ p["W"] + same @ p["S"]
        top = np.maximum.reduceat(z, starts)
        # where each filter has its maximum in each document
        at = np.stack([starts[i] + z[a : a + n].argmax(0) for i, (a, n) in enumerate(zip(starts, sizes, strict=True))])
        pooled = np.maximum(top + p["b"], 0)
        h = np.tanh(pooled @ p["H"] + p["c"])
        q = 1 / (1 + np.exp(-(h @ p["v"] + p["d"][0])))
        dz = ((q - y) * w / len(y)).astype(np.float32)
        dh = np.outer(dz, p["v"]) * (1 - h * h)
        dp = (dh @ p["H"].T) * (pooled > 0)
        # a filter that fires nowhere still learns a little
        dp += 0.05 * (dh @ p["H"].T) * (pooled <= 0)
        flat, f = at.ravel(), np.tile(np.arange(FILTERS), len(data))
        d = dp.ravel()
        xb = x[flat]
        e = p["E"][xb].reshape(len(flat), -1)
        gW = np.zeros_like(p["W"])
        gS = np.zeros_like(p["S"])
        back = np.empty((len(flat), CHUNK * EMBED), np.float32)
        for k in range(FILTERS):
            i = np.flatnonzero(f == k)
            gW[:, k] = d[i] @ e[i]
            gS[:, k] = d[i] @ same[flat[i]]
            back[i] = np.outer(d[i], p["W"][:, k])
        gE = np.zeros_like(p["E"])
        np.add.at(gE, xb.ravel(), back.reshape(-1, EMBED))
        return {"E": gE, "W": gW, "S": gS, "b": dp.sum(0), "H": pooled.T @ dh, "c": dh.sum(0), "v": h.T @ dz, "d": np.array([dz.sum()], np.float32)}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 13) -> Network:
    """docs(doc_id, text), labels(doc_id, quality). The sample is bounded: about per_class documents of each label, by the
    number of labels whose document has a text. Training prefers neither label; 0.5 stands at even odds of the two."""
    named = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    there = docs.where("text is not null").join(named, "doc_id").select("doc_id", "quality", "text")
    per = {r["quality"]: r["count"] for r in there.groupBy("quality").count().collect()}
    net = Network()
    if len(per) < 2:
        net.constant = {(0,): 0.0, (1,): 1.0}.get(tuple(per), 0.5)
        return net
    share = F.when(F.col("quality") == 1, F.lit(min(1.0, per_class / per[1]))).otherwise(F.lit(min(1.0, per_class / per[0])))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # ids are drawn before texts are read: about 2 * per_class rows whatever the input
    drawn = named.where(u < share)
    rows = docs.where("text is not null").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in rows], float)
    if len(set(y)) < 2:
        net.constant = per[1] / (per[0] + per[1])
        return net
    net.train([r["text"].encode() for r in rows], y)
    del rows
    trim()
    return net


def score(docs: DataFrame, net: Network, text: bool = True) -> DataFrame:
    """docs(text, ...) with score added; an input column of that name gives way, and the text if not asked for."""
    own = [c for c in docs.columns if c != "score"]
    kept = [c for c in own if text or c != "text"]
    schema = docs.select(*kept).schema.add("score", "double")
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = net.score([(t.as_py() or "").encode() for t in part.column(at)])
                yield pa.RecordBatch.from_arrays([*(c for n, c in zip(own, part.columns, strict=True) if n in kept), pa.array(found, pa.float64())], [*kept, "score"])

    lean(docs.sparkSession)
    return docs.select(*own).mapInArrow(lambda it: tidy(run(it)), schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    from treesum.llm.language import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    net = fit(docs, labels.where(~held_out(3, 1)))
    scored = score(docs.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "text"), net, text=False)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
