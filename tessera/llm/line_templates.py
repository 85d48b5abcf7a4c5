"""Line dedup with a log-template tree.

A line's tokens are its runs of non-space; a token with a digit counts as a variable field. The tree has a fixed
depth: the number of tokens, then ``DEPTH`` leading tokens. Within a leaf, lines join the template that
agrees with them in at least ``similarity`` of all positions, and positions that differ become variable
fields, most frequent lines first. A template found in at least ``min_docs`` documents recurs: its
lines are dropped everywhere but for its first occurrence (least document id, then line).

All documents are parsed in one pass that sends, for each document and different line, its place in the tree and
16 bits a token. Lines are counted by two numbers each; only the lines of leaves that could hold a recurring
template travel whole, once. What reaches a leaf is one row for each different line. Leaves of every size are clustered alike: first each of the leaf's ``SLICES`` slices
(by a hash of the line), in parallel, then the templates of all slices with each other. Templates are looked up
by the tokens that a line must share with them, which finds the same ones as a comparison with all.
The sum over a template's lines only bounds its documents; the different ids of what passes are counted.

Defined results: null text has no lines, and an empty text one, which is kept; lines of fewer than
``MIN_TOKENS`` tokens have no template and are kept; rows with one id count as one document, but each loses
lines of its own text only; rows with a null id count by text and come last; of equal lines in one
document all but the first occurrence go; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, merged, partitions, table, with_sub

MIN_TOKENS, DEPTH, SLICES = 3, 3, 16
#: Lines that a task clusters at once, or more where one slice holds more.
LINES_A_BUCKET = 20_000
#: Tasks over which the lines of one template are dealt: a template may hold a third of all lines.
SALT = 64
_DIGITS = K.byte_class(b"0123456789")
LINES = "leaf long, key long, id long, sub long, lines array<int>, tokens binary"
#: Templates of slices: the key of a template's weightiest line, and the keys of all its lines.
TEMPLATES = "leaf long, template long, docs long, tokens binary, keys array<long>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.slices(whole, "text"):
            w = K.words(batch.column("text"))
            if not len(w.doc):
                continue
            digits = np.concatenate([[0], np.cumsum(_DIGITS[w.data])])
            token = np.where(digits[w.end] > digits[w.start], np.uint64(0), w.hash | np.uint64(1))
            breaks = np.flatnonzero(w.data == 10)
            _, offsets = K.text_buffer(batch.column("text"))
            line = np.searchsorted(breaks, w.start) - np.searchsorted(breaks, offsets[:-1])[w.doc]
            begin = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])))
            count = np.diff(np.append(begin, len(token)))
            position = np.arange(len(token)) - np.repeat(begin, count)
            with np.errstate(over="ignore"):
                each = K.mix(token + position.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                key = np.add.reduceat(each, begin) * np.uint64(3) + count.astype(np.uint64)
            long = count >= MIN_TOKENS
            begin, count, key, doc, line = begin[long], count[long], key[long], w.doc[begin][long], line[begin][long]
            if not len(begin):
                continue
            with np.errstate(over="ignore"):
                leaf = count.astype(np.uint64)
                for i in range(DEPTH):
                    leaf = K.mix(leaf * np.uint64(31) + each[begin + i])
            order = np.lexsort((line, key, doc))
            begin, count, key, doc, line, leaf = (x[order] for x in (begin, count, key, doc, line, leaf))
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(line, pa.int32()))
            width = count[first]
            ends = np.concatenate([[0], np.cumsum(width)])
            take = np.repeat(begin[first] - ends[:-1], width) + np.arange(ends[-1])
            short = np.where(token[take] == 0, np.uint64(0), (token[take] >> np.uint64(48)) | np.uint64(1)).astype("<u2")
            tokens = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), pa.py_buffer(short.tobytes())])
            at = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([pa.array(leaf[first].view(np.int64)), pa.array(key[first].view(np.int64)), batch.column("id").take(at), batch.column("sub").take(at), lists, tokens], ["leaf", "key", "id", "sub", "lines", "tokens"])


def cluster(lines: np.ndarray, similarity: float, patterns: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Template number of each line (rows of token hashes, all of one length, the weightiest first), and with
    ``patterns`` the templates; 0 is a variable field."""
    n = lines.shape[1]
    need = math.ceil(similarity * n)
    templates, out = np.zeros((16, n), np.uint16), np.zeros(len(lines), np.int64)
    used = 0
    # templates by (position, token); one that agrees in ``need`` positions agrees in one of any n - need + 1
    posts: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
    for i, x in enumerate(lines):
        at = list(enumerate(x.tolist()))
        few = sorted((posts.get(p, ()) for p in at), key=len)[: n - need + 1]
        near = np.array(sorted(set().union(*few)), np.int64)
        agree = (templates[near] == x).sum(1)
        if len(near) and agree.max() >= need:
            t = int(near[agree.argmax()])
            for j in np.flatnonzero((templates[t] != x) & (templates[t] != 0)).tolist():
                templates[t, j] = 0
                posts[j, 0].append(t)
        else:
            if used == len(templates):
                templates = np.concatenate([templates, np.zeros_like(templates)])
            t, used = used, used + 1
            templates[t] = x
            for p in at:
                posts[p].append(t)
        out[i] = t
    return (out, templates[:used]) if patterns else out


def _groups(table_: pa.Table, by: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """The rows of each group, the weightiest first: columns and tokens."""
    col = {c: table_.column(c).to_numpy() for c in (*by, "key", "docs")}
    tokens = table_.column("tokens").combine_chunks()
    order = np.lexsort((col["key"], -col["docs"], *(col[c] for c in by)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in by:
        new[1:] |= col[c][order][1:] != col[c][order][:-1]
    for at in np.split(order, np.flatnonzero(new)[1:]):
        yield {c: x[at] for c, x in col.items()}, np.stack([np.frombuffer(tokens[i].as_buffer(), "<u2") for i in at.tolist()])


def _slices(similarity: float):
    def run(table_: pa.Table) -> pa.Table:
        """Templates of each slice of a leaf, with their lines."""
        out = []
        for col, tokens in _groups(table_, ["leaf", "slice"]):
            which, patterns = cluster(tokens, similarity, patterns=True)
            order = np.argsort(which, kind="stable")
            for pattern, rows in zip(patterns, np.split(order, np.flatnonzero(np.diff(which[order])) + 1), strict=True):
                out.append((col["leaf"][0], col["key"][rows[0]], col["docs"][rows].sum(), pattern.astype("<u2").tobytes(), col["key"][rows]))
        columns = list(zip(*out, strict=True))
        return pa.table({"leaf": pa.array(columns[0], pa.int64()), "template": pa.array(columns[1], pa.int64()), "docs": pa.array(columns[2], pa.int64()), "tokens": pa.array(columns[3], pa.binary()), "keys": pa.array(columns[4], pa.list_(pa.int64()))})

    return run


def _leaves(min_docs: int, similarity: float):
    def run(table_: pa.Table) -> pa.Table:
        """Templates of slices, each with its template of the leaf, if that one's lines may be in ``min_docs`` documents."""
        part, whole = [], []
        for col, tokens in _groups(table_, ["leaf"]):
            which = cluster(tokens, similarity)
            total = np.bincount(which, weights=col["docs"])
            hit = total[which] >= min_docs
            part.append(col["key"][hit])
            whole.append(col["key"][np.unique(which, return_index=True)[1]][which][hit])
        return pa.table({"t": np.concatenate(part), "whole": np.concatenate(whole)})

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, gone, kept = [], [], []
        for t, out in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            parts = [] if t is None else t.split("\n")
            away = set(out or ())
            left = [x for i, x in enumerate(parts) if i not in away]
            lines.append(len(parts))
            gone.append(len(parts) - len(left))
            kept.append("\n".join(left))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, similarity: float = 0.7) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = with_sub(rows, scratch)
    parsed = scratch.save(rows.mapInArrow(_parse, LINES), "parsed")
    counts = scratch.save(parsed.groupBy("leaf", "key").agg(F.count("*").alias("docs")), "counts")
    leaves = counts.groupBy(F.col("leaf").alias("l")).agg(F.sum("docs").alias("all_docs"), F.count("*").alias("different")).where(F.col("all_docs") >= min_docs)
    leaves = scratch.save(leaves, "leaves")
    buckets = F.lit(max(partitions(spark), leaves.agg(F.coalesce(F.sum("different"), F.lit(0))).first()[0] // LINES_A_BUCKET))
    lines = scratch.save(counts.join(merged(leaves), F.col("leaf") == F.col("l")).select("leaf", F.col("key").alias("k"), "docs"), "lines")
    places = parsed.join(merged(lines.select("k")), F.col("key") == F.col("k")).select("key", "id", "sub", "lines", "tokens")
    places = scratch.save(places, "places")
    scratch.drop(parsed, counts, leaves)
    tokens = places.groupBy("key").agg(F.min("tokens").alias("tokens"))
    in_leaf = lines.join(merged(tokens), F.col("key") == F.col("k")).withColumn("slice", F.pmod("key", F.lit(SLICES)))
    in_leaf = in_leaf.select("leaf", "slice", "key", "docs", "tokens", F.pmod(F.xxhash64("leaf", "slice"), buckets).alias("bucket"))
    sliced = scratch.save(in_leaf.groupBy("bucket").applyInArrow(_slices(similarity), TEMPLATES), "sliced")
    whole = sliced.select("leaf", F.col("template").alias("key"), "docs", "tokens", F.pmod(F.xxhash64("leaf"), buckets).alias("bucket"))
    whole = scratch.save(whole.groupBy("bucket").applyInArrow(_leaves(min_docs, similarity), "t long, whole long"), "whole")
    likely = sliced.select("template", "keys").join(merged(whole), F.col("template") == F.col("t")).select(F.explode("keys").alias("k"), "whole")
    found = places.join(merged(likely), F.col("key") == F.col("k")).select("whole", "id", "sub", "lines")
    found = scratch.save(found, "found")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "sub", F.col("lines")[0].alias("line"))
    met = found.groupBy("whole", "id", F.when(F.col("id").isNull(), F.col("sub")).alias("text")).agg(F.min(first).alias("first")).groupBy(F.col("whole").alias("w"))
    met = met.agg(F.count("*").alias("docs"), F.min("first").alias("keep")).where(F.col("docs") >= min_docs)
    met = met.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "sub"), F.lit(SALT)).cast("int"))
    hit = salted.join(merged(met), (F.col("whole") == F.col("w")) & (F.col("salt") == F.col("s")))
    kept = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("sub") == F.col("keep.sub"))
    gone = F.filter("lines", lambda x: ~(kept & (x == F.col("keep.line"))))
    by_doc = hit.select("id", "sub", F.explode(gone).alias("line")).groupBy(F.col("id").alias("_id"), F.col("sub").alias("_sub")).agg(F.collect_list("line").alias("gone"))
    by_doc = scratch.save(by_doc, "gone")
    scratch.drop(lines, places, sliced, whole, found)
    out = rows.join(merged(by_doc), F.col("id").eqNullSafe(F.col("_id")) & (F.col("sub") == F.col("_sub")), "left").select("id", "text", "gone")
    return out.mapInArrow(_drop, "id long, n_lines long, n_dropped long, kept_text string").withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
