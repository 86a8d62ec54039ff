"""Content-addressed store of token ids.

Every text is encoded, closed with an end id, and its id stream is cut where a rolling hash over the last WINDOW ids
meets a mask, so that equal passages give equal chunks wherever they stand. A store is a folder of four tables:

chunks    hash, n, payload, root, seq, shared    each distinct chunk once, under the hash of its content, with the place
          where it was first found and whether it is found elsewhere
places    hash, root, seq    the other places of shared chunks
recipes   part, doc_id, n_tokens, root, hashes    what each document is made of; parts follow doc_id, rows too
manifest  part, n_docs, n_tokens, digest    digests of the recipe roots in order, by blocks and then by part

A recipe's root is the Merkle root of its chunk hashes. Reading checks every payload against its hash, every document
against its recipe and root and every part against the manifest, and raises where one differs.

Documents with one root are rebuilt once and joined back by the root. A chunk that stands in one place goes straight to
its document; only shared chunks are joined by hash. Offsets are a running sum inside a part plus the
totals of the parts before it; there are as many parts as shuffle partitions, which bounds what that broadcast holds.

Defined results: a null text counts as empty (one id, the end id); null ids stand first; rows that repeat or share an
id are separate documents, in order of content; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treesum.llm.common import drop, drop_path, lean, stage, stage_path, tidy

#: Ids a cut looks back on; least and most ids of a chunk; beyond the least, one place in MASK + 1 is a cut.
WINDOW, LEAST, MOST, MASK = 16, 128, 4096, 255
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Distinct pieces a worker remembers, and their ids.
WORDS, IDS = 1_000_000, 8_000_000
#: Row numbers that are broadcast at most; above, they are joined by shuffle.
BROADCAST = 1_000_000


def _kinds(blanks: bytes, digits: bytes = b"", letters: bytes = b"") -> np.ndarray:
    """The kind of each byte: 0 blank, 1 digit, 2 letter, 3 other; those of characters beyond ASCII are letters."""
    return np.array([0 if b in blanks else 1 if b in digits else 2 if b in letters or b > 127 else 3 for b in range(256)], np.uint8)


#: Kinds of bytes of lower-case plain texts; of any other text, where nothing but blanks cuts.
_PLAIN, _BLANKS = _kinds(b"\t\n\r ", b"0123456789", bytes(range(97, 123))), _kinds(b"\t\n ", letters=bytes(range(128)))


def pieces(texts: list[str], kinds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Runs of bytes of one kind that is not blank, digits by themselves: the distinct ones, which of them each is, in the
    order of the texts, and how many each text has."""
    if not texts:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = [t.encode() for t in texts]
    all_ = np.frombuffer(b" ".join(raw), np.uint8)
    k = kinds[all_]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (k[1:] == 1)])
    at = np.flatnonzero(new)
    real = k[at] != 0
    d = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(all_))), pa.py_buffer(all_)).dictionary_encode()
    which = d.indices.to_numpy()[real]
    # runs of blanks leave the dictionary
    used = np.zeros(len(d.dictionary), bool)
    used[which] = True
    distinct = d.dictionary.to_numpy(zero_copy_only=False)[used].tolist()
    ends = np.cumsum([len(r) + 1 for r in raw])
    return distinct, (np.cumsum(used) - 1)[which], np.diff(np.searchsorted(at[real], ends), prepend=0)


class _Numbers(dict):
    """A number for each piece, in the order in which they are first asked for; new ones are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        i = self[piece] = self.begun + len(self.new)
        self.new.append(piece)
        return i

    begun = 0


class WordIds:
    """Ids of a text by the tokenizers library, words encoded once each.

    The tokenizer lower-cases, drops white space and encodes each letter run, digit and run of other marks by itself.
    Where a text has only ASCII without apostrophes and precomposed Latin-1 letters, those pieces are cut here and only
    pieces not seen before go to the library's model; any other text goes to the library between blanks, and one that
    holds an added token as a whole. Texts are cut together, by the kinds of their bytes, and each distinct piece of a
    batch is looked up once."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # their strings in a text become their ids, as the library has it
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.plain = re.compile("[\t\n\r -&(-~À-ÖØ-öø-ÿ]*").fullmatch
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        # the byte-level alphabet: bytes that show as themselves, the others from 256 on
        shown, more = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
        self.mapped = {b: chr(b) if b in shown else chr(next(more)) for b in range(256)}
        self.model = self.whole.model
        self.clear()

    def clear(self) -> None:
        """Pieces known so far, by number; where their ids begin in one flat array, with room to grow."""
        self.at = _Numbers()
        self.flat, self.begin, self.used = np.zeros(1 << 16, np.uint32), np.zeros((1 << 14) + 1, np.int64), 0

    def _numbered(self, pieces: list[str], plain: bool) -> np.ndarray:
        """Numbers of pieces, whose ids are known then. Plain ones are lower-case pieces that only the model would cut
        further, and go to it alone; all others go through all steps."""
        at = self.at
        at.new = []
        which = np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces))
        if at.new:
            cut, shown = self.model.tokenize, self.mapped.__getitem__
            whole = lambda p: self.whole.encode(p, add_special_tokens=False).ids
            if plain:
                found = [[t.id for t in cut(p if p.isascii() else "".join(map(shown, p.encode())))] if len(p) <= 2000 else whole(p) for p in at.new]
            else:
                found = list(map(whole, at.new))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            n, ids = at.begun + len(found), int(sizes.sum())
            if self.used + ids > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), ids), np.uint32)])
            if n >= len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros(max(len(self.begin), len(found)), np.int64)])
            self.flat[self.used : self.used + ids] = np.fromiter(chain.from_iterable(found), np.uint32, ids)
            self.begin[at.begun + 1 : n + 1] = self.used + np.cumsum(sizes)
            self.used += ids
            at.begun = n
        return which

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has."""
        if self.at.begun > WORDS or self.used > IDS:
            self.clear()
        # 1: plain, 2: cut at blanks, 3: whole
        how, own = np.zeros(len(texts), np.int8), ([], [], [])
        for i, t in enumerate(texts):
            if t:
                how[i] = 3 if any(a in t for a in self.added) else 1 if self.plain(t) else 2
                own[how[i] - 1].append(t.lower() if how[i] == 1 else t)
        cut = [pieces(own[0], _PLAIN), pieces(own[1], _BLANKS), (own[2], np.arange(len(own[2])), np.ones(len(own[2]), np.int64))]
        sizes = np.zeros(len(texts), np.int64)
        for j, (_, _, n) in enumerate(cut, 1):
            sizes[how == j] = n
        w, of = np.zeros(int(sizes.sum()), np.int64), np.repeat(how, sizes)
        for j, (distinct, which, _) in enumerate(cut, 1):
            w[of == j] = self._numbered(distinct, j == 1)[which]
        # whole texts are not remembered
        for t in own[2]:
            self.at.pop(t, None)
        lo, n = self.begin[w], self.begin[w + 1] - self.begin[w]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        docs = np.cumsum([0, *sizes.tolist()])
        upto = np.concatenate([[0], ends])
        return ids, upto[docs[1:]] - upto[docs[:-1]]

    def __call__(self, text: str) -> list[int]:
        return self.batch([text])[0].tolist()


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def rolled(ids: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW ids up to and with each place: a rolling sum of mixed ids, mixed again."""
    with np.errstate(over="ignore"):
        v = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
        v ^= v >> np.uint64(29)
        total = np.cumsum(v * _ODD)
        h = total.copy()
        h[WINDOW:] -= total[:-WINDOW]
        h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(32))


def cuts(places: np.ndarray, n: int) -> list[int]:
    """Where the chunks of n ids end; places: those after which the hash asks for a cut. A cut depends on the WINDOW ids
    before it and on the last cut, nothing else."""
    out, last = [], 0
    while n - last > LEAST:
        i = np.searchsorted(places, last + LEAST)
        last = min(int(places[i]) if i < len(places) else n, last + MOST, n)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def digest(b: bytes) -> bytes:
    return blake2b(b, digest_size=16).digest()


def merkle(hashes: list[bytes]) -> bytes:
    """Root over hashes: pairs are hashed until one is left; an odd one out is lifted."""
    level = [digest(b"\0" + h) for h in hashes]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_ROWS = "row long, doc_id long, seq int, n_tokens long, root binary, hashes array<binary>, hash binary, n int, payload binary"


def _chunked(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode = word_ids(path)
    # row numbers are the task's and its rows', so a task that runs again numbers alike
    count = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    kind = np.dtype("<u2" if encode.width == 2 else "<u4")
    names = [x.split()[0] for x in _ROWS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.int32(), pa.binary()]
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows: list[tuple] = []
            ids, sizes = encode.batch(part.column(1).to_pylist())
            ids = np.insert(ids, np.cumsum(sizes), end).astype(kind)
            ends_of = np.cumsum(sizes + 1)
            asked = np.flatnonzero((rolled(ids) & np.uint64(MASK)) == 0) + 1
            for doc_id, lo_id, hi_id in zip(part.column(0).to_pylist(), [0, *ends_of.tolist()], ends_of.tolist(), strict=False):
                n = hi_id - lo_id
                # a hash counts from the place where all its WINDOW ids are the document's own
                i, j = np.searchsorted(asked, [lo_id + WINDOW, hi_id])
                ends = cuts(asked[i:j] - lo_id, n)
                own = ids[lo_id:hi_id]
                payloads = [own[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
                hashes = [digest(p) for p in payloads]
                root = merkle(hashes)
                rows += [(count + i, doc_id, i, n, root, None if i else hashes, h, len(p) // kind.itemsize, p) for i, (h, p) in enumerate(zip(hashes, payloads, strict=True))]
                count += len(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _manifest(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, digest) of recipes: roots in order, hashed in blocks of 256 rows, then by part."""
    row = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "root")) - 1
    r = recipes.select("part", "n_tokens", "doc_id", "root", row.alias("i")).withColumn("block", F.floor(F.col("i") / 256))
    listed = lambda v, k: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v]), ""), 256)
    r = r.withColumn("leaf", F.concat_ws(":", F.col("doc_id"), F.hex("root")))
    blocks = r.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), listed("leaf", "i").alias("d"))
    return blocks.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), listed("d", "block").alias("digest"))


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = 2) -> None:
    """Encodes docs(doc_id, text) into a store in folder."""
    spark, path = docs.sparkSession, path or default_vocabulary()
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    staged = stage_path(spark, "ids")
    # payloads are nearly as dense as they get: they are written as they are, but for a quick pass
    zstd, quick = (lambda df, c=c: df.write.option("compression", c) for c in ("zstd", "snappy"))
    lean(spark)
    quick(d.mapInArrow(lambda it: tidy(_chunked(it, path, end), word_ids(path).clear), _ROWS)).parquet(staged)
    rows = spark.read.schema(_ROWS).parquet(staged)
    # of chunks with one hash the first row is kept; payloads are not shuffled for it while the row numbers of repeated
    # chunks are few enough to be broadcast, by count
    keys = rows.select("hash", "row")
    first = keys.groupBy("hash").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = stage(keys.join(first, "hash").select("row", (F.col("row") == F.col("first")).alias("kept")), "again")
    again_ = F.broadcast(again) if again.count() <= BROADCAST else again
    unique = rows.join(again_, "row", "left").where("coalesce(kept, true)")
    quick(unique.select("hash", "n", "payload", "root", "seq", F.col("kept").isNotNull().alias("shared"))).parquet(f"{folder}/chunks")
    # rows of documents with one root name the same places
    zstd(rows.select("hash", "root", "seq", "row").join(again_, "row").where("not kept").select("hash", "root", "seq").distinct()).parquet(f"{folder}/places")
    drop(again)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = rows.where("seq = 0").select("doc_id", "n_tokens", "root", "hashes")
    recipes = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    zstd(recipes).parquet(f"{folder}/recipes")
    zstd(_manifest(spark.read.parquet(f"{folder}/recipes"))).parquet(f"{folder}/manifest")
    drop_path(spark, staged)


def _rebuilt(batches: Iterator[pa.RecordBatch], width: int, sums: bool) -> Iterator[pa.RecordBatch]:
    """(root, seq, payload, hashes), sorted, a recipe (seq -1) before the chunks of each document, to (root, n, ids as
    little-endian unsigned 32-bit integers, or their crc32 alone), checked."""
    done: tuple[list, list, list] = ([], [], [])
    root, hashes, own = None, None, []

    def close() -> None:
        if root is None:
            return
        if hashes is None or merkle(hashes) != root:
            raise ValueError(f"document {root.hex()} does not match its root")
        for h, p in zip_longest(hashes, own):
            if p is None or h is None or digest(p) != h:
                raise ValueError(f"chunk {(h or root).hex()} is missing or does not match its hash")
        ids = np.frombuffer(b"".join(own), f"<u{width}").astype("<u4")
        done[0].append(root)
        done[1].append(len(ids))
        done[2].append(zlib.crc32(ids) if sums else ids.tobytes())

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.int64() if sums else pa.binary())], ["root", "n", "crc32" if sums else "ids"])
        for c in done:
            c.clear()
        return out

    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            for r, seq, payload, listed in zip(*(c.to_pylist() for c in batch.slice(lo, 2048).columns), strict=True):
                if r != root:
                    close()
                    root, hashes, own = r, None, []
                if seq < 0:
                    hashes = listed
                # documents with one root name the same places; where one is left out, the next does not fit its hash
                elif seq >= len(own):
                    own.append(payload)
            if done[0]:
                yield rows()
    close()
    if done[0]:
        yield rows()


def check_manifest(spark: SparkSession, folder: str) -> None:
    """Raises unless the recipes are those that the manifest was made of."""
    said, found = spark.read.parquet(f"{folder}/manifest"), _manifest(spark.read.parquet(f"{folder}/recipes"))
    odd = said.exceptAll(found).select("part").union(found.exceptAll(said).select("part")).first()
    if odd is not None:
        raise ValueError(f"part {odd[0]} of {folder} does not match its manifest")


def documents(spark: SparkSession, folder: str, width: int = 2, sums: bool = False) -> DataFrame:
    """(root, n, ids) of each distinct document of a store, rebuilt from its chunks; with sums (root, n, crc32)."""
    lean(spark)
    one = lambda **c: [F.lit(None).cast(t).alias(n) if n not in c else c[n].alias(n) for n, t in (("root", "binary"), ("seq", "int"), ("payload", "binary"), ("hashes", "array<binary>"))]
    chunks = spark.read.parquet(f"{folder}/chunks")
    pieces = chunks.select(*one(root=F.col("root"), seq=F.col("seq"), payload=F.col("payload")))
    other = spark.read.parquet(f"{folder}/places").join(chunks.where("shared").select("hash", "payload"), "hash")
    other = other.select(*one(root=F.col("root"), seq=F.col("seq"), payload=F.col("payload")))
    recipes = spark.read.parquet(f"{folder}/recipes").select(*one(root=F.col("root"), seq=F.lit(-1), hashes=F.col("hashes")))
    whole = pieces.unionByName(other).unionByName(recipes).repartition("root").sortWithinPartitions("root", "seq")
    return whole.mapInArrow(lambda it: _rebuilt(it, width, sums), "root binary, n long, " + ("crc32 long" if sums else "ids binary"))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, root, start, n_tokens): start counts the ids of all documents before."""
    recipes = spark.read.parquet(f"{folder}/recipes").select("part", "doc_id", "root", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.parquet(f"{folder}/manifest").select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    r = recipes.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return r.join(F.broadcast(parts), "part").select("doc_id", "root", (F.col("_base") + F.col("_before")).alias("start"), "n_tokens")


def op10_store(spark, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "store")
    path = default_vocabulary()
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, path)
    check_manifest(spark, folder)
    sums = documents(spark, folder, word_ids(path).width, sums=True).select("root", F.col("n").alias("n_read"), F.col("crc32").alias("ids_crc32"))
    return index(spark, folder).join(sums, "root").select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")
