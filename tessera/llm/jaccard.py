"""Exact n-gram Jaccard join with adaptive multi-match prefixes, down to connected groups.

1. *Sets.* A document's set is that of its distinct word shingles, as 64-bit hashes. Documents with
   the same set (by two further hashes and its size) form a class, whose least id stands for it.
2. *Order.* Tokens are ordered by frequency: tokens found often come last, by their counts, all others
   first, by hash. Counts come from all documents; only how much work is done hangs on them.
3. *Prefixes.* If two sets are similar, then for every l their prefixes of n - ceil(t n) + l tokens share
   at least l tokens. Each document's l follows from its estimated candidate cost, the counts of its
   prefix tokens: the dearer, the longer its prefix and the more tokens must be shared. A pair is
   held to the smaller l of the two.
4. *Stars.* A token shared by many similar documents would make all pairs of a group. So a first and a
   second round pair each document only with the leader of a token (one row each), verify its best
   pair, and join components.
5. *Rest.* What the stars left apart is compared in full: all pairs under a token whose components
   differ and that share l prefix tokens are verified on whole sets. No pair that could join two
   components is left out, so the groups are exact; pairs inside a component need no verification.
   A document's tokens before its l-th shared one that no other prefix holds are *own* tokens: were one
   in a similar set, it would come before the l-th common token there and so be in that prefix. Own
   tokens lie outside the intersection, which bounds the similarity of a pair before it is made: the
   many different edits of one text, which share a token but are not similar, do not meet in pairs.
   So does a bitmap of the whole set, the parity of its tokens in each of 256 places: two bitmaps differ
   in at most as many places as their sets have different tokens.

Defined results: a text without words has an empty set and is linked with nothing; fewer words than a
shingle make one shingle; a null id gets a null group; rows with one id are one node; copies of a
text are one class; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import LOWER, UPPER, Scratch, merged, table
from .components import components

#: Shingles counted together in a task; a token seen so often among them is reported.
BLOCK, SEEN = 2_000_000, 6
#: Most tokens that the frequency table holds (16 bytes each); beyond, only the more frequent ones.
TABLE = 1_000_000
#: Reported count from which a token counts as frequent.
FREQUENT = 64
#: l begins at 2 and grows by 1 for so many tokens of the set (a longer text costs more to verify), and is
#: doubled, tripled, ... from so many estimated candidates.
TOKENS_A_MATCH, COSTS = 64, (256, 1024, 4096)
#: Columns of a set's bitmap.
BITS = ("b0", "b1", "b2", "b3")


def doc_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds."""
    w = K.words(batch.column("text"), K.NON_SPACE, lower=True)
    at = K.whole_grams(w, k)
    doc, h = w.doc[at], K.gram_hashes(w.hash, k)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(w.bounds)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        seq = w.hash[w.bounds[d] : w.bounds[d + 1]]
        doc, h = np.append(doc, d), np.append(h, K.gram_hashes(seq, len(seq), seed=1))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(batch.num_rows + 1))


def _sizes(k: int):
    """(id, n, f1, f2): size and fingerprint of each set. Sums of independently mixed hashes do not depend on order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                h, b = doc_sets(batch, k)
                fp = []
                for seed in (3, 4):
                    s = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(h ^ K.seeded(seed)), dtype=np.uint64)])
                    fp.append((s[b[1:]] - s[b[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(b), pa.int64()), pa.array(fp[0]), pa.array(fp[1])], ["id", "n", "f1", "f2"])

    return run


def _frequent(k: int):
    """(token, c): tokens seen often within a block of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            token, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= SEEN
            return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], ["token", "c"])

        for whole in batches:
            for batch in K.slices(whole, "text"):
                h, _ = doc_sets(batch, k)
                held.append(h)
                size += len(h)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _ceil_share(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-n * num // den)


def _prefixes(k: int, num: int, den: int, frequent):
    """(id, n, l, tokens, b0 to b3): the tokens of each prefix, in order, and the bitmap of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = frequent.value
        for whole in batches:
            for batch in K.slices(whole, "text"):
                h, b = doc_sets(batch, k)
                n = np.diff(b)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                    c = np.where(tokens[at] == h, counts[at], 0)
                else:
                    c = np.zeros(len(h), np.int64)
                doc = np.repeat(np.arange(len(n)), n)
                bits = np.zeros((len(n), 4), np.uint64)
                place = K.mix(h ^ K.seeded(5))
                np.bitwise_xor.at(bits, (doc, (place >> np.uint64(6)) & np.uint64(3)), np.uint64(1) << (place & np.uint64(63)))
                order = np.lexsort((h, c, doc))
                h, c = h[order], c[order]
                slack = n - _ceil_share(n, num, den)
                total = np.concatenate([[0], np.cumsum(c)])
                base = 2 + n // TOKENS_A_MATCH
                cost = total[np.minimum(b[:-1] + slack + base, b[1:])] - total[b[:-1]]
                level = np.minimum(base * (1 + np.searchsorted(np.array(COSTS), cost, "right")), np.maximum(n - slack, 1))
                length = np.minimum(slack + level, n)
                offsets = np.concatenate([[0], np.cumsum(length)])
                take = np.repeat(b[:-1] - offsets[:-1], length) + np.arange(offsets[-1])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[take].view(np.int64)))
                parity = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in bits.T]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(level, pa.int64()), lists, *parity], ["id", "n", "l", "tokens", *BITS])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed: a third of what their hashes take when they travel to be compared."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([press.compress((t.as_py() or "").encode()) for t in batch.column("text")], pa.binary())], ["id", "z"])


def _compare(k: int, num: int, den: int):
    """Pairs whose whole sets are similar. Rows come sorted by b, whose set is kept for its next row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        last, q = None, np.zeros(0, np.uint64)

        def tokens(z: bytes) -> np.ndarray:
            return doc_sets(pa.RecordBatch.from_arrays([pa.array([plain.decompress(z).decode()])], ["text"]), k)[0]

        for batch in batches:
            keep = []
            for i, (b, x, y) in enumerate(zip(batch.column("b").to_pylist(), batch.column("s"), batch.column("t"), strict=True)):
                if b != last:
                    last, q = b, tokens(y.as_py())
                p = tokens(x.as_py())
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                if den * both >= num * (len(p) + len(q) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for every row of docs: documents link when
    den * |intersection| >= num * |union|; component_id is the least id reachable by links, class_id
    the least id with the same set."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = scratch.save(rows.mapInArrow(_sizes(words), "id long, n long, f1 long, f2 long"), "sizes")
    classes = scratch.save(sizes.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = classes.where("rep is not null").select(F.col("rep").alias("r")).distinct()

    counted = scratch.save(rows.mapInArrow(_frequent(words), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT), "frequent")
    least, room = FREQUENT, TABLE
    for r in counted.groupBy(F.floor(F.log2("c")).alias("e")).count().orderBy(F.desc("e")).collect():  # at most 64 rows
        room -= r["count"]
        if room < 0:
            least = 1 << (r["e"] + 1)
            break
    kept = counted.where(F.col("c") >= least).toPandas()
    token = kept["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    frequent = spark.sparkContext.broadcast((token[order], kept["c"].to_numpy(np.int64)[order]))

    made = scratch.save(rows.mapInArrow(_prefixes(words, num, den, frequent), "id long, n long, l long, tokens array<long>, b0 long, b1 long, b2 long, b3 long"), "made")
    prefix = scratch.save(made.join(merged(reps), F.col("id") == F.col("r"), "left_semi"), "prefix")
    frequent.unpersist()
    scratch.drop(made, counted)
    shared = scratch.save(prefix.select(F.explode("tokens").alias("k")).groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"), "shared")
    met = prefix.select("id", F.posexplode("tokens").alias("pos", "token")).join(merged(shared), F.col("token") == F.col("k"))
    met = met.groupBy(F.col("id").alias("i")).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("met"))
    nodes = prefix.select("id", "n", "l", *BITS).join(merged(met), F.col("id") == F.col("i"))
    own = F.when(F.size("met") >= F.col("l"), F.try_element_at("met", F.col("l").cast("int"))["pos"] - F.col("l") + 1).otherwise(F.col("n"))
    # documents that share a token of their prefix: size, l, bitmap, own tokens, and the shared tokens with their places.
    nodes = scratch.save(nodes.select("id", "n", "l", own.alias("own"), F.col("met")[0]["pos"].cast("long").alias("own1"), *BITS, "met"), "nodes")
    texts = rows.mapInArrow(_pack, "id long, z binary").join(merged(nodes.select(F.col("id").alias("r"))), F.col("id") == F.col("r"), "left_semi")
    texts = scratch.save(texts, "texts")
    scratch.drop(prefix, shared)

    def verify(pairs: DataFrame) -> DataFrame:
        one = texts.select(F.col("id").alias("i"), F.col("z").alias("s"))
        two = texts.select(F.col("id").alias("j"), F.col("z").alias("t"))
        with_a = one.join(merged(pairs), F.col("a") == F.col("i")).select("a", "b", "s")
        with_b = with_a.join(merged(two), F.col("b") == F.col("j")).select("a", "b", "s", "t")
        return with_b.mapInArrow(_compare(words, num, den), "a long, b long")

    def close(n1: str, n2: str):
        return F.least(n1, n2) * den >= F.greatest(n1, n2) * num

    def overlap(n1: str, n2: str):
        """Least intersection of two similar sets of these sizes."""
        return F.floor(((F.col(n1) + F.col(n2)) * num + num + den - 1) / (num + den))

    def near(n1: str, n2: str, bits1: list[str], bits2: list[str]):
        """Whether two sets may differ in so few tokens that they are similar."""
        apart = reduce(add, (F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(bits1, bits2, strict=True)))
        return (F.col(n1) + F.col(n2)) * (den - num) >= apart * (den + num)

    def renamed(of: DataFrame, s: str) -> DataFrame:
        return of.select(*[F.col(c).alias(f"{c}_{s}") for c in of.columns])

    def bits(s: str) -> list[str]:
        return [f"{b}_{s}" for b in BITS]

    stars = spark.createDataFrame([], "node long, label long")
    for seed in (None, 1):
        labelled, apart = _apart(nodes, stars, seed, scratch)
        cand = _entries(labelled).join(merged(apart), F.col("token") == F.col("k")).where("id != leader")
        cand = cand.groupBy(F.col("id").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("c"))
        known = labelled.select("id", "n", "l", "label", *BITS)
        cand = cand.join(merged(renamed(known, "x")), F.col("a") == F.col("id_x")).where("2 * c >= l_x").join(merged(renamed(known, "y")), F.col("b") == F.col("id_y"))
        cand = cand.where((F.col("label_x") != F.col("label_y")) & close("n_x", "n_y") & near("n_x", "n_y", bits("x"), bits("y")))
        best = scratch.save(cand.groupBy("a").agg(F.max(F.struct("c", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "pairs")
        stars = _grow(stars, verify(best), scratch)
        scratch.drop(best, labelled, apart)
    labelled, apart = _apart(nodes, stars, 2, scratch)
    slack = F.col("n") - F.floor((F.col("n") * num + den - 1) / den)
    open_ = _entries(labelled).join(merged(apart.select("k")), F.col("token") == F.col("k"), "left_semi").select("token", F.col("id").alias("i"), "pos")
    known = labelled.select("id", "n", "own", "own1", "label", (F.col("l") + slack).alias("reach"), "l", *BITS)
    open_ = scratch.save(open_.join(merged(known), F.col("i") == F.col("id")).drop("i"), "open")
    x, y = renamed(open_, "x"), renamed(open_, "y")
    similar = near("n_x", "n_y", bits("x"), bits("y"))
    met = x.join(y, (F.col("token_x") == F.col("token_y")) & (F.col("id_x") < F.col("id_y")) & (F.col("label_x") != F.col("label_y")) & close("n_x", "n_y") & similar)
    # The sizes of a pair give its least overlap; with it a stored prefix reaches beyond l common tokens, to these:
    met = met.withColumn("least", overlap("n_x", "n_y"))
    met = met.withColumn("l", F.least(F.col("reach_x") - F.col("n_x"), F.col("reach_y") - F.col("n_y")) + F.col("least"))
    for s in "xy":
        over = F.col(f"n_{s}") - F.col("least")
        own = F.when(F.col(f"l_{s}") <= F.col("l"), F.col(f"own_{s}")).otherwise(F.col(f"own1_{s}"))
        met = met.where((F.col(f"pos_{s}") < over + F.col("l")) & (own <= over))
    pairs = met.groupBy(F.col("id_x").alias("a"), F.col("id_y").alias("b"), "l").agg(F.count("*").alias("c")).where("c >= l").select("a", "b")
    pairs = scratch.save(pairs, "pairs")
    stars = _grow(stars, verify(pairs), scratch)
    scratch.drop(nodes, labelled, apart, texts, open_, pairs)

    found = sizes.join(classes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), "rep"), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")), "left")
    found = scratch.save(found.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "found")
    out = found.join(stars, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"), F.col("rep").alias("class_id"))


def _entries(nodes: DataFrame) -> DataFrame:
    """A row for each shared token of a document, with its place in the prefix."""
    return nodes.select("id", F.explode("met").alias("e")).select("id", "e.token", F.col("e.pos").cast("long").alias("pos"))


def _apart(nodes: DataFrame, stars: DataFrame, seed: int | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents with their component, and the tokens under which components differ, each with a leader: the
    document with the fewest own tokens, or by a seed any."""
    labelled = nodes.join(merged(stars), F.col("id") == F.col("node"), "left").select(*nodes.columns, F.coalesce("label", "id").alias("label"))
    labelled = scratch.save(labelled, "labelled")
    key = F.col("own") if seed is None else F.xxhash64("id", F.lit(seed))
    entries = labelled.select("id", "label", key.alias("key"), F.explode("met.token").alias("k"))
    apart = entries.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("key", "id")).alias("lead")).where("lo != hi")
    return labelled, scratch.save(apart.select("k", F.col("lead.id").alias("leader")), "apart")


def _grow(stars: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    return components(stars.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links), scratch)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_groups(docs, words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
     common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
     link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
     reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
