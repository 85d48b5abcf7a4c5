"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``window`` consecutive words of a benchmark item is a pattern (an item with fewer
words, but not none, is one pattern). Patterns of one length m form a matcher:

* a *block shift table* says, for the two-word block that ends a text window, how far the window may
  move before any pattern could end there; blocks that no pattern holds skip m - 1 words;
* where the shift is nought, *suffix-hash buckets* select the patterns that end in this block;
* *direct comparison* confirms, first on all word hashes, then on the words' bytes.

The items' words lie in arrays once; a pattern is a place in them (about 150 bytes a word in all). Items go to the
executors in groups of at most ``GROUP_BYTES`` of text, or one larger item, with one pass over the documents for each;
between passes the documents and what was found are written, so that one group is in memory at a time.

Texts are scanned by many cursors at once (numpy), each over a stretch of one document.

Defined results: a null or empty text has no words and no hits; an item without id or words takes no
part; repeated rows are judged each by itself; columns of the input that bear a name of the result
are replaced; with empty tables nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import LOWER, UPPER, Scratch, table

#: Cursors work on stretches of so many window starts.
STRETCH = 256
#: Item text that is searched in one pass.
GROUP_BYTES = 8 << 20
COLUMNS = ("n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated")


class Items:
    """The words of all items, one after the other."""

    def __init__(self, items: list[tuple[str, str]]):
        parts, self.names = [], [i for i, _ in items]
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.large_string())], ["text"])
        bytes_, docs = 0, 0
        for x in K.slices(batch, "text"):
            w = K.words(x.column("text"), K.ALNUM, lower=True)
            parts.append((w.data, w.start + bytes_, w.end + bytes_, w.hash, w.doc + docs))
            bytes_, docs = bytes_ + len(w.data), docs + x.num_rows
        empty = [(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        self.data, self.start, self.end, self.hash, doc = (np.concatenate(x) for x in zip(*(parts or empty), strict=True))
        self.doc = doc.astype(np.int32)

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True)]


class Matcher:
    """Patterns of one length: runs of m words that begin at the words ``starts`` of the items."""

    def __init__(self, m: int, items: Items, starts: np.ndarray):
        self.m, self.block, self.words = m, min(2, m), items
        h = items.hash
        gram = K.gram_hashes(h, m)[starts]
        suffix = self._pair(h[starts + m - self.block], h[starts + m - 1])
        order = np.lexsort((items.doc[starts], gram, suffix))
        starts, gram, suffix = starts[order], gram[order], suffix[order]
        first = np.flatnonzero(np.append(True, (suffix[1:] != suffix[:-1]) | (gram[1:] != gram[:-1])))
        self.suffix, self.at = suffix[first], starts[first]
        self.owners, self.bounds = items.doc[starts], np.append(first, len(starts))
        bits = max(10, int(np.ceil(np.log2(max(1, len(first) * m)))) + 1)
        self.mask = K.U64((1 << min(bits, 26)) - 1)
        self.shift = np.full(int(self.mask) + 1, m - self.block + 1, np.uint16)
        for j in range(m - self.block + 1):
            block = self._pair(h[self.at + j], h[self.at + j + self.block - 1])
            np.minimum.at(self.shift, (block & self.mask).astype(np.int64), m - self.block - j)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return K.mix(a * K.U64(0x9E3779B97F4A7C15) ^ b)

    def scan(self, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word indexes) and patterns of all occurrences."""
        m, h = self.m, w.hash
        counts = np.diff(w.bounds) - m + 1
        docs = np.flatnonzero(counts > 0)
        pieces = -(-counts[docs] // STRETCH)
        base = np.repeat(w.bounds[docs], pieces)
        nth = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pos = base + nth * STRETCH
        stop = np.minimum(pos + STRETCH, base + np.repeat(counts[docs], pieces))
        found_at, found = [], []
        while len(pos):
            block = self._pair(h[pos + m - self.block], h[pos + m - 1])
            step = self.shift[(block & self.mask).astype(np.int64)].astype(np.int64)
            due = np.flatnonzero(step == 0)
            if len(due):
                at, b = pos[due], block[due]
                low, high = np.searchsorted(self.suffix, b, "left"), np.searchsorted(self.suffix, b, "right")
                while len(at := at[keep := low < high]):
                    low, high = low[keep], high[keep]
                    same = (h[at[:, None] + np.arange(m)] == self.words.hash[self.at[low][:, None] + np.arange(m)]).all(1)
                    found_at.append(at[same])
                    found.append(low[same])
                    at, low, high = at[~same], low[~same] + 1, high[~same]
                step[due] = 1
            pos = pos + step
            on = pos < stop
            pos, stop = pos[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, which = np.concatenate(found_at), np.concatenate(found)
        sure = np.fromiter((w.text(i, i + m) == self.words.text(p, p + m) for i, p in zip(at.tolist(), self.at[which].tolist(), strict=True)), bool, len(at))
        return at[sure], which[sure]

    def items(self, pattern: int) -> list[str]:
        return [self.words.names[i] for i in set(self.owners[self.bounds[pattern] : self.bounds[pattern + 1]].tolist())]


def matchers(items: list[tuple[str, str]], window: int) -> list[Matcher]:
    words = Items(items)
    size = np.bincount(words.doc, minlength=len(items))
    left = (np.cumsum(size)[words.doc] - np.arange(len(words.doc))) if len(words.doc) else np.zeros(0, np.int64)  # words from here to the item's end
    length = np.minimum(size[words.doc], window)
    return [Matcher(m, words, np.flatnonzero((length == m) & (left >= m))) for m in np.unique(length).tolist()]


def _search(found: list[Matcher], text_col: str, out: pa.Schema):
    """Add to ``_items`` and ``_spans`` what these patterns hit; with ``_spans`` absent in the input they begin empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, text_col):
                w = K.words(batch.column(text_col), K.ALNUM, lower=True)
                before = batch.schema.get_field_index("_spans") >= 0
                n = batch.num_rows
                hit = np.zeros(len(w.doc) + 1, np.int64)
                items: list[set[str]] = [set(x) for x in batch.column("_items").to_pylist()] if before else [set() for _ in range(n)]
                if before:
                    for d, spans in enumerate(batch.column("_spans").to_pylist()):
                        for s in spans:
                            hit[w.bounds[d] + s["start"]] += 1
                            hit[w.bounds[d] + s["end"]] -= 1
                for x in found:
                    at, which = x.scan(w)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + x.m, -1)
                    for d, p in set(zip(w.doc[at].tolist(), which.tolist(), strict=True)):
                        items[d].update(x.items(p))
                inside = np.cumsum(hit[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                spans: list[list[dict]] = [[] for _ in range(n)]
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    while a < b:  # a run may go on into the next document
                        d = int(w.doc[a])
                        e = min(b, int(w.bounds[d + 1]))
                        spans[d].append({"start": a - int(w.bounds[d]), "end": e - int(w.bounds[d])})
                        a = e
                columns = {name: batch.column(name) for name in batch.schema.names}
                columns |= {"_n_words": pa.array(np.diff(w.bounds), pa.int64()), "_items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "_spans": pa.array(spans, out.field("_spans").type)}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)

    return run


_STATE = T.StructType(
    [T.StructField("_n_words", T.LongType()), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit (words inside an occurrence), n_items and items (whose
    windows occur), hit_spans (word ranges, end exclusive) and contaminated (n_hit > 0)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    docs = docs.drop(*COLUMNS, *_STATE.names)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    groups = 1 + (items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // GROUP_BYTES
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        tables = spark.sparkContext.broadcast(matchers([(r.item, r.text) for r in part.toLocalIterator()], window))
        schema = T.StructType([f for f in docs.schema if f.name not in _STATE.names] + list(_STATE))
        found = docs.mapInArrow(_later(tables, text_col, to_arrow_schema(schema)), schema)
        if g + 1 == groups:
            docs = found
            break
        before, docs = docs, scratch.save(found, "pass")
        tables.unpersist()
        if g:
            scratch.drop(before)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return docs.select(
        *[f.name for f in docs.schema if f.name not in _STATE.names], F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), F.col("_spans").alias("hit_spans"), (F.size("_spans") > 0).alias("contaminated")
    )


def _later(tables, text_col: str, out: pa.Schema):
    def run(batches):
        yield from _search(tables.value, text_col, out)(batches)

    return run


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = rf"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
     sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM iw WHERE len(w) > 0),
     pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p
             FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
     dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     lens AS (SELECT DISTINCT m FROM pat),
     win AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
             FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
     hit AS (SELECT doc_id, i, m, item_id FROM win JOIN pat USING (m, p)),
     words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
