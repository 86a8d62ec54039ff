"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways of cutting it into pieces, of the product of their probabilities, by a forward algorithm; that of a text
is the product over its words. Piece probabilities are fitted by expectation maximisation (forward-backward) on word
counts of a bounded, documented sample of labelled texts.

A word is a letter of the lower-cased text and all letters and combining marks after it, whatever its length (numerals
and marks without a letter before them are none), written as a blank and its UTF-8 bytes; the
single bytes are pieces, so every word has a segmentation. Sums are scaled as the forward algorithm goes along, by a
logarithm of their own for each word and language, so that no word underflows. All distinct words of a batch that are
equally long go through it together, in numpy; a worker remembers words up to a bound.

The prediction is the likeliest language, ties to the first by code point; score is its share among the languages'
geometric mean likelihoods per word, and per_byte the mean log probability of a byte of the text's words in it (a blank
for each word counted in), which does not depend on how many languages there are. Defined results: `und` with score 0 and no per_byte where the text is null or has no letter;
repeated rows give repeated rows; other columns are never inputs; an empty table gives an empty result; where no
labelled text exists every prediction is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesum.llm.common import lean, stage, tidy, trim

#: Training: texts per language, about, that are drawn by hash; rounds.
TEXTS, ROUNDS = 500, 5
#: Words a worker remembers, and the letters of the longest.
KNOWN, REMEMBER = 400_000, 48
#: Sums are scaled every so many bytes; bytes of words that are taken together.
RESCALE, TOGETHER = 16, 400_000
#: Pieces are scaled by this per byte, so that products of many stay within range.
SCALE = 8.0
#: log probability of a byte of no language: uniform over the bytes that words may hold.
UNLIKELY = -float(np.log(128 + 26 + 1))
#: A word begins with a letter and goes on with letters and the marks that combine with them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Pieces:
    """The usable pieces of a rank file as a byte trie with dense transitions."""

    def __init__(self, path: str):
        import base64

        with open(path, "rb") as f:
            found = [base64.b64decode(line.split()[0]) for line in f]
        every = set(range(0x80, 0x100)) | set(range(0x61, 0x7B)) | {0x20}
        ok = [p for p in found if set(p) <= every and 0x20 not in p[1:]]
        ok = sorted(set(ok) | {bytes([b]) for b in every})
        self.code = np.full(256, len(every), np.int64)
        for i, b in enumerate(sorted(every)):
            self.code[b] = i
        width = len(every) + 1
        # node 0: nowhere, 1: root, then all beginnings of pieces, those that go on first; all others share a row of zeros
        starts = {p[:j] for p in ok for j in range(1, len(p) + 1)}
        inner = {p[:-1] for p in starts if len(p) > 1}
        starts = [*sorted(inner), *sorted(starts - inner)]
        at = {b"": 1} | {p: i for i, p in enumerate(starts, 2)}
        self.last = len(inner) + 2
        table, piece_of = np.zeros((self.last + 1, width), np.int32), np.full(len(starts) + 2, -1, np.int32)
        for p in starts:
            table[at[p[:-1]], self.code[p[-1]]] = at[p]
        for n, p in enumerate(ok):
            piece_of[at[p]] = n
        self.next = table.ravel()
        self.width, self.piece, self.n = width, piece_of, len(ok)
        self.length = np.array([len(p) for p in ok])

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which words, their codes) by byte length."""
        raw = [b" " + w.encode() for w in words]
        sizes = np.array([len(r) for r in raw])
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if len(group):
                yield group, self.code[np.frombuffer(b"".join(raw[i] for i in group), np.uint8)].reshape(len(group), -1)

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) for all pieces in the rows of codes, by where they begin."""
        m, n = codes.shape
        for i in range(n):
            rows, state = np.arange(m), np.ones(m, np.int64)
            for j in range(i, n):
                state = self.next[np.minimum(state, self.last) * self.width + codes[rows, j]]
                go = state > 0
                rows, state = rows[go], state[go].astype(np.int64)
                if not len(rows):
                    break
                p = self.piece[state]
                ends = p >= 0
                if ends.any():
                    yield i, j + 1, rows[ends], p[ends]

    def forward(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """log probability of each word in each language; weights (pieces, languages) are scaled."""
        out, reach = np.empty((len(words), weights.shape[1])), int(self.length.max()) + 1
        for group, codes in self.groups(words):
            step = max(1, TOGETHER // codes.shape[1])
            for lo in range(0, len(group), step):
                g, c = group[lo : lo + step], codes[lo : lo + step]
                n = c.shape[1]
                # sums at the next places only, in a ring
                alpha, logs = np.zeros((min(reach, n + 1), len(g), weights.shape[1])), np.zeros((len(g), weights.shape[1]))
                alpha[0], at, ring = 1, 0, min(reach, n + 1)
                for i, j, rows, p in self.arcs(c):
                    while at < i:
                        alpha[at % ring] = 0
                        at += 1
                        if at % RESCALE == 0:
                            logs += self._scaled(alpha)
                    alpha[j % ring, rows] += alpha[i % ring, rows] * weights[p]
                with np.errstate(divide="ignore"):
                    out[g] = np.log(alpha[n % ring]) + logs - n * np.log(SCALE)
        return out

    @staticmethod
    def _scaled(alpha: np.ndarray) -> np.ndarray:
        """Divides all sums of a word in a language by the largest of them; the logarithms of what they were divided by."""
        most = alpha.max(0)
        most = np.where(most > 0, most, 1.0)
        alpha /= most
        return np.log(most)

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Piece probabilities of one language."""
        p = (0.02 ** np.minimum(self.length, 4)).astype(float)
        p /= p.sum()
        scale, reach = SCALE**self.length, int(self.length.max()) + 1
        kept = []
        for g, c in self.groups(words):
            step = max(1, TOGETHER // c.shape[1])
            kept += [(counts[g[lo : lo + step]], c[lo : lo + step]) for lo in range(0, len(g), step)]
        # arcs of words of common length are listed once; those of long ones in each round
        listed = [[*self.arcs(c)] if c.shape[1] <= 4 * REMEMBER else None for _, c in kept]
        for _ in range(rounds):
            w, seen = p * scale, np.zeros(self.n)
            for (count, c), known in zip(kept, listed, strict=True):
                n = c.shape[1]
                arcs = known if known is not None else [*self.arcs(c)]
                # forward sums, with all that lie ahead, are scaled so that each place has 1 when it is left, backward sums
                # by the same numbers, so that an arc's share of the word is the product of its ends and its piece
                alpha, beta, by = np.zeros((n + 1, len(c))), np.zeros((n + 1, len(c))), np.ones((n + 1, len(c)))
                alpha[0] = beta[n] = 1
                at = 0
                for i, j, rows, q in arcs:
                    while at < i:
                        at += 1
                        by[at] = np.where(alpha[at] > 0, alpha[at], 1.0)
                        alpha[at : at + reach] /= by[at]
                    alpha[j, rows] += alpha[i, rows] * w[q]
                by[n] = np.where(alpha[n] > 0, alpha[n], 1.0)
                for i, j, rows, q in reversed(arcs):
                    part = w[q] * beta[j, rows] / by[i + 1 : j + 1, rows].prod(0)
                    beta[i, rows] += part
                    seen += np.bincount(q, alpha[i, rows] * part * count[rows], self.n)
            p = seen + 0.02
            p /= p.sum()
        return p


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Model:
    """Learned languages and piece probabilities."""

    def __init__(self, path: str, langs: list[str], p: np.ndarray):
        self.path, self.langs, self.p = path, langs, p

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces(model.path)
        self.weights = model.p * SCALE ** self.pieces.length[:, None]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        if len(self.at) > KNOWN:
            self.clear()
        at, new, ids, sizes, once, lengths = self.at, [], [], [], [], []
        for t in texts:
            own = words_of(t) if t else []
            for w in own:
                i = at.get(w)
                if i is None:
                    i = at[w] = len(self.table) + len(new)
                    new.append(w)
                    if len(w) > REMEMBER:
                        once.append(w)
                ids.append(i)
            sizes.append(len(own))
            lengths.append(len(own) + sum(map(len, own)) if t and t.isascii() else sum(1 + len(w.encode()) for w in own))
        if new:
            self.table = np.concatenate([self.table, self.pieces.forward(new, self.weights)])
        for w in once:
            del at[w]
        langs, out, scores, per_byte = self.model.langs, [], [], []
        sums = np.zeros((len(texts), max(1, len(langs))))
        if ids and langs:
            some = np.flatnonzero(sizes)
            starts = np.cumsum([0, *np.array(sizes)[some][:-1]])
            sums[some] = np.add.reduceat(self.table[np.array(ids)], starts, axis=0)
        for n, length, s in zip(sizes, lengths, sums, strict=True):
            if not n or not langs:
                out.append("und")
                scores.append(0.0)
                per_byte.append(None)
                continue
            e = np.exp((s - s.max()) / n)
            out.append(langs[int(np.argmax(s))])
            scores.append(float(1 / e.sum()))
            per_byte.append(float(s.max()) / length)
        return out, scores, per_byte


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken")


def fit(docs: DataFrame, path: str | None = None, texts: int = TEXTS, seed: int = 11) -> Model:
    """docs(doc_id, text, lang). Draws about `texts` texts of each language by a hash of their ids (all of them, if fewer),
    counts their words on the executors and fits each language on all of them."""
    path = path or default_vocabulary()
    d = docs.where("lang is not null and text is not null")
    per = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not per:
        return Model(path, [], np.zeros((pieces(path).n, 0)))
    share = F.create_map(*[x for k, v in per.items() for x in (F.lit(k), F.lit(min(1.0, texts / v)))])
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = d.where(u < F.element_at(share, F.col("lang"))).select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            n: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n.setdefault(lang, Counter()).update(words_of(text.as_py()))
            rows = [(lang, w, c) for lang, own in n.items() for w, c in own.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    # the texts are split once, not once per language
    counts = stage(drawn.mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(per, key=str.encode)
    p = []
    for lang in langs:
        # the words of about `texts` texts, whatever the input
        top = counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").toPandas()
        p.append(pieces(path).fit(top["word"].tolist(), top["n"].to_numpy(float)))
        trim()
    return Model(path, langs, np.stack(p, axis=1))


def identify(docs: DataFrame, model: Model, text: bool = True) -> DataFrame:
    """docs(text, ...) with lang_pred, score and per_byte added; input columns of these names give way, and the text if not
    asked for."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "per_byte")]
    kept = [c for c in own if text or c != "text"]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("per_byte", "double")
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                langs, scores, per_byte = score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c for n, c in zip(own, part.columns, strict=True) if n in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(per_byte, pa.float64())], [*kept, "lang_pred", "score", "per_byte"])

    lean(docs.sparkSession)
    return docs.select(*own).mapInArrow(lambda it: tidy(run(it)), schema)


def held_out(mod: int, left: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == left


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(F.coalesce(~held_out(4, 2), F.lit(True))))
    scored = identify(docs.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "text"), model, text=False)
    return scored.select("doc_id", "held_out", "lang_pred", "score")
