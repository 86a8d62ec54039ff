"""Byte-level BPE by a monoid tree reduction.

A text is encoded in halves down to leaves of LEAF characters, whose matches of the pre-split pattern are merged by the
ranks here. Two encoded neighbours are joined by encoding again only a window around the seam, grown until the tokens
outside it provably stand:

* between matches: the window doubles until it holds, on either side of the seam, a place where a match ends whatever
  surrounds it. A letter before anything else is one, so is a number before anything else and a mark other than the
  apostrophe before anything that is no mark: no alternative of the pattern goes on there, and none looks behind.
* inside a match of more than PIECE bytes, which is encoded in parts itself: a token row is the encoding of its bytes
  exactly if each pair of neighbours encodes to itself. The window doubles until the pairs at both of its edges do.

Runs of one mark or one letter are matches as long as the text, in which edges may shift token by token and windows may
have to grow to the whole. Parts of a match are therefore cut at powers of two, where runs agree with their tokens; a match
whose window passes SHIFTING tokens is merged as one window at once, with a heap, instead of at every level; and a seam is
not put inside a match when there is no sure boundary near it, but at the nearest one.

Decoding concatenates bytes up the same kind of tree, from leaves of LEAF_IDS ids. The tiktoken library is what tests
hold the results to; no text goes through it.

Defined results: a null text counts as empty; an empty text has no tokens; rows that repeat give repeated rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesum.llm.common import lean, tidy

#: Characters of a leaf, ids of a leaf of decoding, bytes of a match above which it is encoded in halves itself.
LEAF, LEAF_IDS, PIECE = 512, 256, 64
#: Characters, and tokens inside a match, on either side of a seam that a window starts with.
WINDOW, TOKENS = 24, 4
#: Tokens of a window inside a match above which the whole match is one; characters about a middle with a sure boundary, else
#: it moves; bytes from which merges go by a heap.
SHIFTING, NEAR, HEAP = 1024, 4096, 256
#: Matches of a generation that a worker remembers; it remembers two.
KNOWN = 150_000


class Shifting(Exception):
    """A match in which seams move tokens far away."""


class _Known(dict):
    """Ids by match; a match not seen before is encoded, and kept unless it is long. Those of the generation before are
    kept while they are asked for."""

    def __init__(self, encode, longest: int):
        self.encode, self.longest, self.before = encode, longest, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.before.get(piece)
        if ids is None:
            ids = tuple(self.encode(piece.encode()))
        if len(piece) <= self.longest:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()


class TreeBPE:
    """Encoder and decoder over a rank file that tiktoken reads; pattern must be one whose matches end where _SAFE says."""

    _SAFE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])"

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, piece: int = PIECE):
        import base64

        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        # the rank that two neighbours merge to, by both of theirs; ranks have 20 bits
        rank = self.ranks.get
        self.byte = [rank(bytes([b])) for b in range(256)]
        self.merged = {a << 20 | b: r for k, r in self.ranks.items() for i in range(1, len(k)) if (a := rank(k[:i])) is not None and (b := rank(k[i:])) is not None}
        self.split = regex.compile(pattern).findall
        self.before, self.after = regex.compile("(?r)" + self._SAFE).search, regex.compile(self._SAFE).search
        self.leaf, self.piece = leaf, piece
        self.known = _Known(self._match, piece)
        self.small: dict[bytes, list[int]] = {}
        self.pair = lru_cache(1 << 16)(self._pair)

    # text level

    def forget(self) -> None:
        self.known.turn()
        self.known.before = {}
        self.small.clear()
        self.pair.cache_clear()

    def encode(self, text: str) -> list[int]:
        if len(self.known) > KNOWN:
            self.known.turn()
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        near = slice(max(lo, mid - NEAR), min(hi, mid + NEAR))
        if hi - lo > 2 * NEAR and not (self.after(text, mid, near.stop) and self.before(text, near.start, mid + 1)):
            return self._apart(text, lo, mid, hi)
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _apart(self, text: str, lo: int, mid: int, hi: int) -> list[int]:
        """Halves that meet at the sure boundary nearest to mid, so that the seam is in no match; one leaf if there is none."""
        found = [m.start() for m in (self.before(text, lo, mid + 1), self.after(text, mid, hi)) if m and lo < m.start() < hi]
        if not found:
            return self._leaf(text[lo:hi])
        at = min(found, key=lambda x: abs(x - mid))
        return self._encode(text, lo, at) + self._encode(text, at, hi)

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Encoding of text[lo:hi] of those of its halves."""
        a, b, w = -1, -1, WINDOW
        while a < 0 or b < 0:
            if a < 0:
                # a place at the seam counts for either side
                m = self.before(text, max(lo, mid - w), mid + 1)
                a = m.start() if m else lo if mid - w <= lo else -1
            if b < 0:
                m = self.after(text, mid, min(hi, mid + w + 1))
                b = m.start() if m else hi if mid + w >= hi else -1
            w *= 2
        if a == b:
            return left + right
        i, j = self._back(left, len(text[a:mid].encode())), self._ahead(right, len(text[mid:b].encode()))
        if a < mid < b and b - a > self.piece and all(len(self.split(text[x:y])) == 1 for x, y in ((a, b), (a, mid), (mid, b))):
            # the seam is inside one long match, and both of its parts are encoded as matches
            middle = self._join_bytes(left[i:], right[:j])
        else:
            middle = self._leaf(text[a:b])
        return left[:i] + middle + right[j:]

    def _back(self, ids: list[int], n: int) -> int:
        """Where the last n bytes of ids begin."""
        i = len(ids)
        while n > 0:
            i -= 1
            n -= len(self.bytes_of[ids[i]])
        assert n == 0, "a seam that is no token boundary"
        return i

    def _ahead(self, ids: list[int], n: int) -> int:
        i = 0
        while n > 0:
            n -= len(self.bytes_of[ids[i]])
            i += 1
        assert n == 0, "a seam that is no token boundary"
        return i

    def _leaf(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    # inside a match

    def _merge(self, piece: bytes) -> list[int]:
        """The neighbours of least rank are merged until none has one."""
        one = self.ranks.get(piece)
        if one is not None:
            return [one]
        if len(piece) > HEAP:
            return self._merge_long(piece)
        merged, none = self.merged.get, len(self.ranks) + 1
        parts = [self.byte[b] for b in piece]
        costs = [merged(a << 20 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            parts[i] = least
            del parts[i + 1], costs[i]
            if i < len(costs):
                costs[i] = merged(least << 20 | parts[i + 1], none)
            if i:
                costs[i - 1] = merged(parts[i - 1] << 20 | least, none)
        return parts

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of (rank, place) in one number; entries that no longer hold are passed over."""
        merged, n = self.merged.get, len(piece)
        parts = [self.byte[b] for b in piece]
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := merged(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        place, pop, push = (1 << 40) - 1, heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & place, x >> 40
            j = ahead[i]
            if j >= n or parts[i] < 0 or merged(parts[i] << 20 | parts[j]) != r:
                continue
            parts[i], parts[j] = r, -1
            k = ahead[i] = ahead[j]
            if k < n:
                back[k] = i
                if (c := merged(r << 20 | parts[k])) is not None:
                    push(heap, c << 40 | i)
            h = back[i]
            if h >= 0 and (c := merged(parts[h] << 20 | r)) is not None:
                push(heap, c << 40 | h)
        return [x for x in parts if x >= 0]

    def _pair(self, a: int, b: int) -> bool:
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _match(self, piece: bytes) -> list[int]:
        try:
            return self._parts(piece)
        except Shifting:
            return self._merge(piece)

    def _parts(self, piece: bytes) -> list[int]:
        if len(piece) <= self.piece:
            ids = self.small.get(piece)
            if ids is None:
                if len(self.small) > KNOWN:
                    self.small.clear()
                ids = self.small[piece] = self._merge(piece)
            return ids
        mid = 1 << (len(piece) - 1).bit_length() - 1
        return self._join_bytes(self._parts(piece[:mid]), self._parts(piece[mid:]), SHIFTING)

    def _join_bytes(self, left: list[int], right: list[int], most: int | None = None) -> list[int]:
        """Shifting, if a window of `most` tokens on either side is not enough."""
        w = TOKENS
        while True:
            if most is not None and w > most:
                raise Shifting
            i, j = max(0, len(left) - w), min(len(right), w)
            middle = self._merge(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.pair(left[i - 1], middle[0])) and (j == len(right) or self.pair(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            w *= 2

    # decoding

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(2)
def encoder(path: str, pattern: str) -> TreeBPE:
    return TreeBPE(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, digests: bool) -> Iterator[pa.RecordBatch]:
    e = encoder(path, pattern)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            n, ids_of, ids_sha, decoded_sha = [], [], [], []
            for text in part.column(1):
                ids = e.encode(text.as_py() or "")
                raw = np.array(ids, dtype="<u4").tobytes()
                n.append(len(ids))
                if digests:
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    decoded_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
                else:
                    ids_of.append(raw)
            out = [part.column(0), pa.array(n, pa.int64())]
            out += [pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())] if digests else [pa.array(ids_of, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers. path must be readable on every executor."""
    own = default_vocabulary()
    path, pattern = path or own[0], pattern or own[1]
    lean(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(lambda it: tidy(_encoded(it, path, pattern, False), encoder(path, pattern).forget), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded(doc_id, ids) to (doc_id, bytes)."""
    own = default_vocabulary()
    path, pattern = path or own[0], pattern or own[1]

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = [e.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding of every whole text in one pass."""
    own = default_vocabulary()
    path, pattern = path or own[0], pattern or own[1]
    lean(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(lambda it: tidy(_encoded(it, path, pattern, True), encoder(path, pattern).forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
