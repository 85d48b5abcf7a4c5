"""Substring dedup over a log-structured fingerprint index.

Every window of 20 words is told by its *anchor*, the least of the 11 hashes of 10 consecutive words in it.
Neighbouring windows mostly share an anchor, so about one entry for six words covers all windows: the anchor's
64-bit hash, the offsets of the windows in which it is the anchor, a 64-bit digest of these windows in
order, and the place. Equal windows have the same anchor at the same offset.

The index is a list of immutable runs. A run holds, for each bucket of anchor hashes, the entries that a
batch of documents was first to bring, sorted. A new batch (documents later than all indexed
ones) is deduplicated in one shuffle by bucket, where its sorted entries are merged with those of the runs:

* anchors met once are done;
* an entry with the anchor, offsets and digest of an earlier one repeats all of its windows (128 bits);
* where entries of one anchor differ otherwise, some of their windows may be equal. These few entries are
  *verified*: their windows are read again from the texts and compared by offset and 128 bits of two more
  hashes of their words; every window but the first is a repeat.

What is new becomes the next run; when there are more than ``fanout`` runs they are merged into one. With a
``path`` the runs stay in that folder, and a later job goes on from there.

Entries equal within a task are merged before the shuffle (only the earliest travels, the rest are
repeats already), so a passage in a third of all documents costs one entry a task.

Defined results: a null text has no words; texts of fewer than 20 words lose nothing; documents come in order of id,
null ids last, and rows with one id (or none) in order of a hash of their text; rows equal in id and text are one
document, and both lose the same words; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, merged, packed, table, unpacked, with_sub

WINDOW, GRAM = 20, 10
SPAN = WINDOW - GRAM  # words of a window beside its anchor; also the largest offset
#: Entries that a task holds before it sends them on.
HELD = 300_000
ENTRIES_A_BUCKET = 250_000
#: Stands for a null id; a null id's sub is odd, that of any other even.
LAST_ID = (1 << 63) - 1
BLOBS = "bucket int, kind int, data binary"
#: Kinds of blobs: entries of the batch, entries of runs, ranges of repeated words, entries to be verified.
NEW, OLD, RANGES, OPEN = 0, 1, 2, 3
RANGE = np.dtype([("id", "<i8"), ("sub", "<i8"), ("start", "<i8"), ("end", "<i8")])
ENTRY = np.dtype([("fp", "<u8"), ("lo", "u1"), ("hi", "u1"), ("digest", "<u8"), ("id", "<i8"), ("sub", "<i8"), ("at", "<u4")])
#: Entries sort by what tells them apart, then by place.
SAME, PLACE = ("fp", "lo", "hi", "digest"), ("id", "sub", "at")


def pack(e: np.ndarray) -> bytes:
    raw = b"".join(e[c].tobytes() for c in ENTRY.names)
    return len(e).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], n * ENTRY.itemsize, "zstd", asbytes=True)
    out, at = np.zeros(n, ENTRY), 0
    for c in ENTRY.names:
        out[c] = np.frombuffer(raw, ENTRY[c], n, at)
        at += n * ENTRY[c].itemsize
    return out


def in_order(e: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """Entries sorted; ``first`` goes between what tells them apart and their places. Merges what is sorted already."""
    return np.lexsort((*(e[c] for c in reversed(PLACE)), *first, *(e[c] for c in reversed(SAME))))


def differs(e: np.ndarray, columns: tuple[str, ...]) -> np.ndarray:
    """Whether each entry differs in these columns from the one before it."""
    out = np.ones(len(e), bool)
    out[1:] = np.logical_or.reduce([e[c][1:] != e[c][:-1] for c in columns])
    return out


def entries_of(batch: pa.RecordBatch) -> np.ndarray:
    """Anchors of all windows of the texts, with where they lie."""
    w = K.words(batch.column("text"), K.NON_SPACE)
    s = K.whole_grams(w, WINDOW)
    if not len(s):
        return np.zeros(0, ENTRY)
    g = K.gram_hashes(w.hash, GRAM)
    best, arg = g[s], np.zeros(len(s), np.int64)
    for j in range(1, SPAN + 1):
        x = g[s + j]
        better = x < best
        best, arg = np.where(better, x, best), np.where(better, j, arg)
    p = s + arg
    begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    at, doc = p[begin], w.doc[p[begin]]
    with np.errstate(over="ignore"):  # a window of 20 words is two grams of 10
        own = K.mix(K.mix(g[s] * np.uint64(0x9E3779B97F4A7C15) ^ g[s + GRAM]) + arg.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        digest = np.add.reduceat(own, begin)
    rows = np.zeros(len(at), ENTRY)
    rows["fp"], rows["hi"], rows["lo"], rows["digest"] = g[at], arg[begin], arg[np.append(begin[1:], len(p)) - 1], digest
    rows["id"], rows["sub"] = (np.asarray(batch.column(c).fill_null(LAST_ID))[doc] for c in ("id", "sub"))
    rows["at"] = at - w.bounds[doc]
    return rows


def repeats_of(e: np.ndarray) -> bytes:
    out = np.zeros(len(e), RANGE)
    at = e["at"].astype(np.int64)
    out["id"], out["sub"], out["start"], out["end"] = e["id"], e["sub"], at - e["hi"], at - e["lo"] + WINDOW
    return out.tobytes()


def _map(buckets: int):
    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(held)
        e = e[in_order(e)]
        same = ~differs(e, SAME) & differs(e, PLACE)  # equal place, as of rows with one id and text, is no repeat
        rows = []
        if same.any():
            rows.append((int(e["fp"][0] % np.uint64(buckets)), RANGES, repeats_of(e[same])))
        e = e[~same]
        b = (e["fp"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        rows += [(i, NEW, pack(e[order[x:y]])) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in K.slices(whole, "text"):
                held.append(entries_of(batch))
                size += len(held[-1])
                if size >= HELD:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    return run


def _merge(keep: bool):
    def run(table_: pa.Table) -> pa.Table:
        """One bucket: what repeats, what is to be verified, and (if to be kept) the entries that are new, sorted."""
        kinds = table_.column("kind").to_pylist()
        blobs = [x.as_py() for x in table_.column("data")]
        bucket = table_.column("bucket")[0].as_py()
        old = [unpack(d) for k, d in zip(kinds, blobs, strict=True) if k == OLD]
        new = [unpack(d) for k, d in zip(kinds, blobs, strict=True) if k == NEW]
        out = [(bucket, RANGES, d) for k, d in zip(kinds, blobs, strict=True) if k == RANGES]
        del blobs
        if new:
            e = np.concatenate([*old, *new])
            fresh = np.arange(len(e)) >= sum(map(len, old))
            order = in_order(e, fresh)
            e, fresh = e[order], fresh[order]
            head = differs(e, SAME)
            lead = np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))
            away = np.logical_or.reduce([e[c] != e[c][lead] for c in PLACE])
            if (fresh & away).any():
                out.append((bucket, RANGES, repeats_of(e[fresh & away])))
            e, fresh = e[head], fresh[head]
            group = np.cumsum(differs(e, ("fp",))) - 1
            doubt = (np.bincount(group) > 1) & (np.bincount(group, weights=fresh) > 0)
            if doubt.any():
                out.append((bucket, OPEN, pack(e[doubt[group]])))
            if keep and fresh.any():
                out.append((bucket, OLD, pack(e[fresh])))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "kind": pa.array([x[1] for x in out], pa.int32()), "data": pa.array([x[2] for x in out], pa.binary())})

    return run


def _compact(table_: pa.Table) -> pa.Table:
    e = np.concatenate([unpack(x.as_py()) for x in table_.column("data")])
    return pa.table({"bucket": pa.array([table_.column("bucket")[0].as_py()], pa.int32()), "kind": pa.array([OLD], pa.int32()), "data": pa.array([pack(e[in_order(e)])], pa.binary())})


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d in batch.column("data"):
            r = np.frombuffer(d.as_py(), RANGE)
            yield pa.RecordBatch.from_arrays([pa.array(r[c]) for c in RANGE.names], list(RANGE.names))


def _doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d in batch.column("data"):
            e = unpack(d.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(e["id"]), pa.array(e["sub"]), pa.array(e["at"].astype(np.int64) - e["hi"]), pa.array(e["at"].astype(np.int64) - e["lo"])], ["id", "sub", "first", "last"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that start at the asked words of each document, by two hashes."""
    for whole in unpacked(batches):
        for batch in K.slices(whole, "text"):
            w = K.words(batch.column("text"), K.NON_SPACE)
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("asked").value_lengths()))
            asked = batch.column("asked").flatten()
            first, last = (np.asarray(asked.field(c)) for c in ("first", "last"))
            start = K.spread(first, last - first + 1)
            doc = np.repeat(doc, last - first + 1)
            at = w.bounds[doc] + start
            h = [K.gram_hashes(K.mix(w.hash ^ K.seeded(seed)), WINDOW, seed)[at] for seed in (7, 8)]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), batch.column("id").take(rows), batch.column("sub").take(rows), pa.array(start)], ["h1", "h2", "id", "sub", "start"])


class FingerprintIndex:
    """Runs of a growing corpus. ``add`` takes documents that come after all before and returns their repeats."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 4, path: str | None = None):
        self.scratch, self.buckets, self.fanout = Scratch(spark, "index"), buckets, fanout
        self.kept = Scratch(spark, "runs", path) if path else self.scratch
        self.runs: list[DataFrame] = self.kept.tables("run", BLOBS) if path else []

    def merge(self, docs: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """docs (id, sub, text) to ranges (id, sub, start, end) of repeated words, end exclusive, which may overlap, and to
        stretches (id, sub, first, last) of window starts to be verified, of this batch and of documents before.
        Without ``keep`` the batch is only compared and makes no run, as for the last one of a corpus."""
        blobs = docs.select("id", "sub", "text").mapInArrow(_map(self.buckets), BLOBS)
        for run in self.runs:
            blobs = blobs.unionByName(run)
        done = self.scratch.save(blobs.groupBy("bucket").applyInArrow(_merge(keep), BLOBS), "merged")
        if keep:
            self.runs.append(self.kept.save(done.where(F.col("kind") == OLD), "run"))
        ranges = self.scratch.save(done.where(F.col("kind") == RANGES).select("data").mapInArrow(_spread, "id long, sub long, start long, end long"), "ranges")
        doubts = self.scratch.save(done.where(F.col("kind") == OPEN).select("data").mapInArrow(_doubtful, "id long, sub long, first long, last long"), "doubts")
        self.scratch.drop(done)
        if len(self.runs) > self.fanout:
            both = self.runs[0]
            for run in self.runs[1:]:
                both = both.unionByName(run)
            kept = self.kept.save(both.groupBy("bucket").applyInArrow(_compact, BLOBS), "run")
            self.kept.drop(*self.runs)
            self.runs = [kept]
        return ranges, doubts

    def verify(self, doubts: DataFrame, texts: DataFrame) -> DataFrame:
        """Of the stretches of windows those that repeat, as ranges; texts (id, sub, text) has all of their documents."""
        asked = doubts.groupBy(F.col("id").alias("i"), F.col("sub").alias("s")).agg(F.collect_set(F.struct("first", "last")).alias("asked"))
        rows = packed(texts.select(F.coalesce("id", F.lit(LAST_ID)).alias("id"), "sub", "text"))
        rows = rows.join(merged(asked), (F.col("id") == F.col("i")) & (F.col("sub") == F.col("s"))).select("id", "sub", "text", "asked")
        windows = self.scratch.save(rows.mapInArrow(_windows, "h1 long, h2 long, id long, sub long, start long"), "windows")
        first = windows.groupBy(F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min(F.struct("id", "sub", "start")).alias("first"))
        found = windows.join(merged(first), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where(F.struct("id", "sub", "start") != F.col("first"))
        out = self.scratch.save(found.select("id", "sub", "start", (F.col("start") + WINDOW).alias("end")).distinct(), "verified")
        self.scratch.drop(windows)
        return out

    def add(self, docs: DataFrame, texts: DataFrame) -> DataFrame:
        """Ranges of a batch; texts has the documents of the batch and of all batches before."""
        ranges, doubts = self.merge(docs)
        new = docs.select(F.coalesce("id", F.lit(LAST_ID)).alias("i"), F.col("sub").alias("s"))
        verified = self.verify(doubts, texts)
        return ranges.unionByName(verified.join(merged(new), (F.col("id") == F.col("i")) & (F.col("sub") == F.col("s")), "left_semi"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in unpacked(batches):
        for batch in K.slices(whole, "text"):
            words, gone, kept = [], [], []
            for t, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                seq = t.encode().split() if t else []  # bytes.split knows just the contract's white space
                words.append(len(seq))
                rest, at = [], 0
                for r in sorted(ranges or [], key=lambda r: r["start"]):
                    if r["end"] > at:
                        rest += seq[at : max(at, r["start"])]
                        at = r["end"]
                rest += seq[at:]
                gone.append(len(seq) - len(rest))
                kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row, feeding the corpus to an index in ``batches`` batches by id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()
    rows = with_sub(rows, scratch)
    index = FingerprintIndex(spark, max(24, stats["size"] // (36 * ENTRIES_A_BUCKET)))
    place = F.coalesce("id", F.lit(LAST_ID))
    cuts = sorted(set(stats["cuts"] or []))
    ranges, doubts = [], []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if lo is None else rows.where(place > lo)
        found = index.merge(part if hi is None else part.where(place <= hi), keep=hi is not None)
        ranges.append(found[0])
        doubts.append(found[1])
    index.scratch.drop(*index.runs)
    verified = index.verify(reduce(DataFrame.unionByName, doubts), rows)
    by_doc = reduce(DataFrame.unionByName, [*ranges, verified]).groupBy(F.col("id").alias("_id"), F.col("sub").alias("_sub")).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = packed(rows).join(merged(by_doc), (place == F.col("_id")) & (F.col("sub") == F.col("_sub")), "left")
    return joined.select("id", "text", "ranges").mapInArrow(_keep, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", "doc_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
     rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM rep),
     word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
     kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
