"""Ranked lexical search: WAND over shards of documents.

1. Items become sets of terms. Their vocabulary is the query side: it is counted first, and items go in blocks of about
   BLOCK (item, term) pairs each, so that what tasks are handed is bounded whatever the table of items.
2. One pass over whole texts keeps, for each document, its number of terms and the counts of those in the vocabulary, and
   writes them to the shared folder. Document counts N, L and df come from all rows of that table.
3. Rows are dealt by a hash of their place to shards of about SHARD postings. A shard orders its documents by id, inverts
   them, and notes each term's greatest impact. For an item, cursors stand in its lists; with the lists in order of their
   cursors, the pivot is the first document whose greatest impacts add up to more than the least score that still enters;
   everything before it is skipped unread, and a document that all cursors up to the pivot stand on is scored.
   The threshold starts at the k-th best sum over an item's rarest lists, which no k-th best score falls below.
4. Heaps of shards are merged in two steps by score and id.

Defined results: null and empty texts, and texts without a term, hold no terms and are never found; rows that repeat are
documents of their own (equal scores, then equal ids, in any order among themselves); a null doc_id stands after all
others; benchmark rows that share an id, null too, are one item with the terms of all; an item without terms finds nothing;
an empty table of either kind gives an empty result; further columns are not read; long texts are read whole, a megabyte
of terms at a time.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treesum.llm.common import lean, read, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: In bytes: what is no digit, letter or part of a longer character parts terms; A-Z become a-z.
_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: (item, term) pairs of a block of items; postings of a shard; bytes of a text that are counted at a time.
BLOCK, SHARD, PIECE = 200_000, 1 << 20, 1 << 20
#: Postings of an item's rarest lists that give its first threshold.
START = 20_000


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def count_terms(text: bytes, known) -> tuple[int, Counter]:
    """Number of terms, and how often each id of `known` (a term's id or None) occurs."""
    n, found, at = 0, Counter(), 0
    text = text.translate(_BYTES)
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        n += len(words)
        found.update(map(known, words))
        at = end
    found.pop(None, None)
    return n, found


def wand(lists: list[tuple], k: int, floor: int) -> list[tuple[int, int]]:
    """The k best (score, document) of lists (documents ascending, impacts, greatest impact) with a score above floor,
    equal scores by the smaller document."""
    heap: list[tuple[int, int]] = []
    docs, impacts, tops = zip(*lists, strict=True)
    at = [0] * len(lists)
    order = sorted((d[0], j) for j, d in enumerate(docs))
    while order:
        reach = 0
        for p, (pivot, j) in enumerate(order):  # noqa: B007
            reach += tops[j]
            if reach > floor:
                break
        else:
            break
        score, end = 0, p + 1
        if order[0][0] == pivot:
            while end < len(order) and order[end][0] == pivot:
                end += 1
            for _, j in order[:end]:
                score += impacts[j][at[j]]
                at[j] += 1
            if score > floor:
                if len(heap) < k:
                    heapq.heappush(heap, (score, -pivot))
                else:
                    heapq.heapreplace(heap, (score, -pivot))
                if len(heap) == k:
                    floor = max(floor, heap[0][0])
            moved = [j for _, j in order[:end]]
        else:
            end = p
            while order[end - 1][0] == pivot:
                end -= 1
            moved = [j for _, j in order[:end]]
            for j in moved:
                at[j] = bisect_left(docs[j], pivot, at[j])
        order[:end] = [(docs[j][at[j]], j) for j in moved if at[j] < len(docs[j])]
        order.sort()
    return [(s, -d) for s, d in heap]


def invert(table: pa.Table, weights: np.ndarray, n: int, length: int) -> tuple[list, dict[int, tuple]]:
    """Ids of a shard's documents in order, and by term: documents (places in that order), impacts, the greatest impact."""
    ids = table["doc_id"].combine_chunks()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((keys, null))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms = table["terms"].combine_chunks()
    many = np.diff(terms.offsets.to_numpy(zero_copy_only=False))
    term, tf = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), table["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    own = table["n"].to_numpy()
    if len(own) and 50 * n * int(own.max()) < 1 << 63:
        m = 50 + 50 * own * n // max(1, length)
    else:
        m = np.array([50 + 50 * int(x) * n // max(1, length) for x in own], np.int64)
    impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, many)))
    doc = np.repeat(place, many)
    by = np.lexsort((doc, term))
    by = by[impact[by] > 0]
    term, doc, impact = term[by], doc[by], impact[by]
    cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    lists = {int(term[a]): (doc[a:b], impact[a:b], int(impact[a:b].max())) for a, b in zip(cuts, [*cuts[1:], len(term)], strict=True)}
    return [None if null[i] else int(keys[i]) for i in order], lists


def first_floor(lists: list[tuple], k: int) -> int:
    """Less by one than the k-th best sum over the rarest lists: what scores no more than this is not among the k best."""
    docs, impacts, total = [], [], 0
    for d, i, _ in sorted(lists, key=lambda x: len(x[0])):
        if total and total + len(d) > START:
            break
        docs.append(d)
        impacts.append(i)
        total += len(d)
    docs = np.concatenate(docs)
    found, where = np.unique(docs, return_inverse=True)
    if len(found) < k:
        return 0
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, where, np.concatenate(impacts))
    return max(0, int(np.partition(sums, len(sums) - k)[len(sums) - k]) - 1)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each pair once."""
    t = items.select(F.col("item_id").cast("long"), F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    return t.distinct()


def _search(postings: DataFrame, items: list[tuple], weights: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """The k best documents of each item in each shard."""

    def shard(table: pa.Table) -> pa.Table:
        ids, lists = invert(table, weights, n, length)
        plain = {t: (array("q", d.tobytes()), array("q", i.astype(np.int64).tobytes()), top) for t, (d, i, top) in lists.items()}
        out: tuple[list, list, list] = ([], [], [])
        for item, terms in items:
            there = [t for t in terms if t in lists]
            if not there:
                continue
            for score, d in wand([plain[t] for t in there], k, first_floor([lists[t] for t in there], k)):
                for column, x in zip(out, (item, ids[d], score), strict=True):
                    column.append(x)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("item_id", "doc_id", "score"), out, strict=True)})

    return postings.groupBy("shard").applyInArrow(shard, "item_id long, doc_id long, score long")


def _best(found: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) to (item_id, rank, doc_id, score): each item's k best with a score above 0."""
    spark = docs.sparkSession
    lean(spark)
    pairs = stage(item_terms(items), "items")
    blocks = max(1, -(-pairs.count() // BLOCK))
    out = [_block(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    by: dict = {}
    ids: dict[str, int] = {}
    for r in pairs.collect():
        by.setdefault(r["item_id"], []).append(ids.setdefault(r["term"], len(ids)))
    items = list(by.items())
    known = {t.encode(): i for t, i in ids.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                n, found = count_terms(text.as_py() or b"", known.get)
                if n:
                    rows.append((doc, n, list(found), list(found.values())))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = stage(texts.mapInArrow(gather, "doc_id long, n long, terms array<int>, tfs array<int>").withColumn("row", F.monotonically_increasing_id()), "terms")
    n, length, postings = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    # one row per term of the vocabulary
    df = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([weight(n, df.get(i, 0)) for i in range(len(ids))], np.int64)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-postings // SHARD), min(tasks, postings // (SHARD // 16)))
    dealt = counted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    found = stage(_search(dealt, items, weights, n, length, k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(shards) + 1))), "found")
    return _best(_best(found, ["item_id", "part"], k), ["item_id"], k).select("item_id", "rank", "doc_id", "score")


def op13_wand(spark, sf_dir: str) -> DataFrame:
    return top_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, n),
p AS (SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws) * n) // l))) AS impact FROM t JOIN f USING (term) JOIN d USING (rid), s),
x AS (SELECT item_id, rid, CAST(sum(impact) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY ALL HAVING sum(impact) > 0),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x JOIN d USING (rid))
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""
