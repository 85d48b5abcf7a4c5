"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

*Graph.* Equal vectors form one node. Lists of ``degree`` neighbours begin with what is nearest inside
cells of a few random hyperplane partitions (cells of bounded size, a larger one is dealt out by hash) and are
improved by descent rounds until few entries change: every node brings a sample of its neighbours and of those that
have it as neighbour together (joins of neighbours of neighbours), compares them with one another, and proposes the
nearest to each of them. In-lists are thinned by a hash against the in-degree, so no hub gathers
more than others.

*Search.* A query starts at its own node. In each hop its best ``beam`` nodes not yet opened are
opened at once: their lists are joined in, nodes seen before drop out, the others are scored where
their vectors lie, and the query keeps its best ``pool``. Hops go on until the nearest of few queries change.
Query vectors travel to the executors in blocks of at most ``BLOCK_BYTES``. What is left within rounding of the
k-th is re-ranked by the exact cosine in double precision.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or whose length
is not the most frequent one take no part, neither as query nor as candidate, nor do null ids; rows with
one id count once (the first vector in byte order); ties go to the smaller id, also among any number
of equal vectors; fewer candidates than asked for are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, table

#: Vectors of a cell, at most twice as many.
CELL = 800
#: Rounds and hops end when so small a share of list entries, or of queries, changes; and after so many.
SETTLED, MOST_ROUNDS, MOST_HOPS = 0.05, 8, 12
#: Cosines in single precision that differ by less may be equal.
ROUNDING = 4e-6
BLOCK_BYTES = 32 << 20
GRAPH = "id long, near binary, sim binary"


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), kind) for x in column]) if len(column) else np.zeros((0, 1), kind)


def _arrays(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _unit(dim: int):
    """Rows with a usable vector, as doubles and as unit vectors in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, unit = [], [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if v is None or len(v) != dim or None in v:
                    continue
                x = np.array(v, np.float64)
                big = np.abs(x).max()
                if np.isfinite(big) and big > 0:
                    y = x / big  # no overflow in the norm
                    ids.append(i)
                    raw.append((x + 0.0).tobytes())
                    unit.append((y / np.sqrt(y @ y)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(unit, pa.binary())], ["id", "raw", "unit"])

    return run


def _least(k: int):
    """The k least ids of each class in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, i = batch.column("class").to_numpy(), batch.column("id").to_numpy()
            order = np.lexsort((i, c))
            c, i = c[order], i[order]
            begin = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
            nth = np.arange(len(c)) - np.repeat(begin, np.diff(np.append(begin, len(c))))
            yield pa.RecordBatch.from_arrays([pa.array(c[nth < k]), pa.array(i[nth < k])], ["class", "member"])

    return run


def _codes(planes: np.ndarray, centre: np.ndarray):
    """One row for each vector and partition, with its cell."""
    trees, bits = planes.shape[0], planes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _matrix(batch.column("unit"))
            if not len(u):
                continue
            for t in range(trees):
                side = (u - centre) @ planes[t].T > 0 if bits else np.zeros((len(u), 0), bool)
                code = side.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t), pa.int32()), pa.array(code), batch.column("id"), batch.column("unit")], ["tree", "cell", "id", "unit"])

    return run


def _top(s: np.ndarray, k: int) -> np.ndarray:
    k = min(k, s.shape[1])
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def _in_cell(degree: int):
    def run(table_: pa.Table) -> pa.Table:
        ids, u = table_.column("id").to_numpy(), _matrix(table_.column("unit").combine_chunks())
        near, sim = [], []
        for a in range(0, len(ids), 512):
            s = u[a : a + 512] @ u.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
            at = _top(s, min(degree, len(ids) - 1)) if len(ids) > 1 else np.zeros((len(s), 0), np.int64)
            near += list(ids[at])
            sim += list(np.take_along_axis(s, at, 1))
        return pa.table({"id": pa.array(ids), "near": _binary(near), "sim": _binary(sim)})

    return run


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows with one key, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        k = batch.column(key).to_numpy()
        if not len(k):
            continue
        edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if held and k[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _batched(rows: Iterator[tuple], build: Callable[[list[tuple]], pa.RecordBatch], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield build(held)
            held = []
    if held:
        yield build(held)


def _best(degree: int):
    """Merge the lists of a node; ``fresh`` counts the entries that no old list of it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for node, t in _by_key(batches, "id"):
                lists, old = _arrays(t.column("near"), np.int64), t.column("old").to_pylist()
                near, sim = np.concatenate(lists), np.concatenate(_arrays(t.column("sim"), np.float32))
                near, first = np.unique(near, return_index=True)
                sim = sim[first]
                keep = near != node
                near, sim = near[keep], sim[keep]
                order = np.lexsort((near, -sim))[:degree]
                known = [x for x, o in zip(lists, old, strict=True) if o]
                fresh = len(np.setdiff1d(near[order], np.concatenate(known))) if known else len(order)
                yield int(node), near[order].tobytes(), sim[order].tobytes(), fresh

        yield from _batched(rows(), lambda r: pa.RecordBatch.from_arrays([pa.array([x[0] for x in r], pa.int64()), pa.array([x[1] for x in r], pa.binary()), pa.array([x[2] for x in r], pa.binary()), pa.array([x[3] for x in r], pa.int64())], ["id", "near", "sim", "fresh"]))

    return run


def _edges(most: int | None):
    """(a, b): b is among the first ``most`` of a's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [x[:most] for x in _arrays(batch.column("near"), np.int64)]
            a = np.repeat(batch.column("id").to_numpy(), [len(x) for x in near])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate(near) if near else np.zeros(0, np.int64))], ["a", "b"])

    return run


def _local_join(propose: int):
    """Compare the neighbours of a node with one another; propose the nearest ones to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, t in _by_key(batches, "a"):
                ids, first = np.unique(t.column("b").to_numpy(), return_index=True)
                if len(ids) < 2:
                    continue
                u = _matrix(t.column("unit").combine_chunks().take(pa.array(first)))
                s = u @ u.T
                np.fill_diagonal(s, -9)
                at = _top(s, min(propose, len(ids) - 1))
                sim = np.take_along_axis(s, at, 1)
                for i, n, x in zip(ids.tolist(), ids[at], sim, strict=True):
                    yield i, n.tobytes(), x.tobytes()

        yield from _batched(rows(), lambda r: pa.RecordBatch.from_arrays([pa.array([x[0] for x in r], pa.int64()), pa.array([x[1] for x in r], pa.binary()), pa.array([x[2] for x in r], pa.binary())], ["id", "near", "sim"]), 20_000)

    return run


class Neighbours:
    """A graph over the vectors of a table, for any number of searches."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", degree: int = 24, trees: int = 4, rounds: int = MOST_ROUNDS, sample: int = 12, seed: int = 5):
        spark = self.spark = vectors.sparkSession
        self.degree, self.rounds, self.hops = degree, 0, 0
        scratch = self.scratch = Scratch(spark, "neighbours")
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null and size(v) > 0")
        common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.dim = common["n"] if common else 1
        usable = rows.mapInArrow(_unit(self.dim), "id long, raw binary, unit binary")
        usable = scratch.save(usable.groupBy("id").agg(F.min(F.struct("raw", "unit")).alias("x")).select("id", "x.raw", "x.unit"), "usable")
        classes = scratch.save(usable.groupBy(F.sha2("raw", 256).alias("hash")).agg(F.min("id").alias("class"), F.count("*").alias("n")), "classes")
        member = usable.select("id", F.sha2("raw", 256).alias("h")).join(classes, F.col("h") == F.col("hash")).select("id", "class")
        self.member = scratch.save(member, "member")
        self.raw = usable.select("id", "raw")
        reps = usable.join(classes.select("class"), F.col("id") == F.col("class"), "left_semi").select("id", "unit")
        self.nodes = scratch.save(reps, "nodes")
        self.graph = self._descend(self._begin(trees, seed), rounds, sample)
        self.lists = self._lists()

    def _merged(self, lists: DataFrame, name: str) -> DataFrame:
        """The best of all lists of a node (id, near, sim, old)."""
        by_node = lists.repartition(partitions(self.spark), "id").sortWithinPartitions("id")
        return self.scratch.save(by_node.mapInArrow(_best(self.degree), f"{GRAPH}, fresh long"), name)

    def _begin(self, trees: int, seed: int) -> DataFrame:
        n, rng = self.nodes.count(), np.random.default_rng(seed)
        bits = max(0, int(np.ceil(np.log2(max(1, n / CELL)))))
        sums = self.nodes.mapInArrow(_sum, "s binary, n long").collect() if n else []  # one row a task
        centre = sum((np.frombuffer(r.s, np.float64) for r in sums), np.zeros(self.dim)) / max(1, n)
        planes = rng.normal(size=(trees if bits else 1, bits, self.dim)).astype(np.float32)
        coded = self.scratch.save(self.nodes.mapInArrow(_codes(planes, centre.astype(np.float32)), "tree int, cell long, id long, unit binary"), "coded")
        counts = self.scratch.save(coded.groupBy(F.col("tree").alias("t"), F.col("cell").alias("c")).agg(F.count("*").alias("n")), "cells")
        parts = F.ceil(F.col("n") / (2.0 * CELL))
        dealt = coded.join(counts, (F.col("tree") == F.col("t")) & (F.col("cell") == F.col("c"))).withColumn("part", F.pmod(F.xxhash64("id", "tree"), parts))
        lists = self.scratch.save(dealt.select("tree", "cell", "part", "id", "unit").groupBy("tree", "cell", "part").applyInArrow(_in_cell(self.degree), GRAPH), "lists")
        out = self._merged(lists.withColumn("old", F.lit(False)), "graph")
        self.scratch.drop(coded, counts, lists)
        return out

    def _reversed(self, edges: DataFrame, most: int) -> DataFrame:
        """Edges turned round, about ``most`` for each end."""
        turned = self.scratch.save(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), "turned")
        degree = self.scratch.save(turned.groupBy(F.col("a").alias("x")).agg(F.count("*").alias("n")), "degree")
        joined = turned.join(degree, F.col("a") == F.col("x"))
        return joined.where(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)) * F.col("n") < most * (1 << 20)).select("a", "b")

    def _descend(self, graph: DataFrame, rounds: int, sample: int) -> DataFrame:
        for _ in range(rounds):
            edges = graph.mapInArrow(_edges(sample), "a long, b long")
            both = self.scratch.save(edges.unionByName(self._reversed(edges, sample)), "edges")
            with_vectors = both.join(self.nodes, F.col("b") == F.col("id")).select("a", "b", "unit")
            met = with_vectors.repartition(partitions(self.spark), "a").sortWithinPartitions("a")
            proposed = self.scratch.save(met.mapInArrow(_local_join(5), GRAPH), "proposed")
            old = graph.select("id", "near", "sim", F.lit(True).alias("old"))
            new = self._merged(old.unionByName(proposed.withColumn("old", F.lit(False))), "graph")
            self.scratch.drop(graph, both, proposed)
            graph = new
            self.rounds += 1
            changed = graph.agg(F.sum("fresh").alias("fresh"), F.sum(F.octet_length("near") / 8).alias("all")).first()
            if not changed["all"] or changed["fresh"] <= SETTLED * changed["all"]:
                break
        return graph

    def _lists(self) -> DataFrame:
        """(node, list): neighbours in both directions, for the search."""
        edges = self.graph.mapInArrow(_edges(None), "a long, b long")
        both = edges.unionByName(self._reversed(edges, self.degree)).distinct()
        return self.scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("list")), "lists")

    def search(self, queries: Column, k: int = 5, beam: int = 160, hops: int = MOST_HOPS, pool: int = 600) -> DataFrame:
        """The k nearest of every vector whose id satisfies ``queries`` (a condition on ``id``): query_id, rank, vec_id, score."""
        asked = self.scratch.save(self.member.where(queries).select(F.col("id").alias("query_id"), "class"), "asked")
        starts = self.scratch.save(self.nodes.join(asked.select("class").distinct(), F.col("id") == F.col("class"), "left_semi"), "starts")
        blocks = 1 + starts.count() * self.dim * 4 // BLOCK_BYTES
        found = None
        for b in range(blocks):
            some = self._search_block(starts.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), k, beam, hops, max(pool, 4 * k))
            found = some if found is None else found.unionByName(some)
        least = self.member.select("class", "id").mapInArrow(_least(k + 1), "class long, member long")  # a query may be one of them itself
        least = self.scratch.save(least.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("member")), 1, k + 1).alias("members")), "least")
        best = found.mapInArrow(_first(k), "q long, c long").unionByName(starts.select(F.col("id").alias("q"), F.col("id").alias("c")))
        pairs = asked.join(best, F.col("class") == F.col("q")).join(least, F.col("c") == least["class"]).select("query_id", F.explode("members").alias("vec_id")).where("query_id != vec_id")
        pairs = self.scratch.save(pairs, "pairs")
        with_q = pairs.join(self.raw.select(F.col("id").alias("i"), F.col("raw").alias("x")), F.col("query_id") == F.col("i")).select("query_id", "vec_id", "x")
        with_c = with_q.join(self.raw.select(F.col("id").alias("j"), F.col("raw").alias("y")), F.col("vec_id") == F.col("j")).select("query_id", "vec_id", "x", "y")
        scored = with_c.mapInArrow(_cosine, "query_id long, vec_id long, score double")
        lists = scored.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id"))), 1, k).alias("best"))
        ranked = lists.select("query_id", F.posexplode("best").alias("pos", "b"))
        return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.d")).alias("score"))

    def _search_block(self, starts: DataFrame, k: int, beam: int, hops: int, pool: int) -> DataFrame:
        rows = starts.collect()  # at most BLOCK_BYTES
        order = np.argsort(np.array([r.id for r in rows], np.int64)) if rows else np.zeros(0, np.int64)
        ids = np.array([rows[i].id for i in order], np.int64)
        unit = np.stack([np.frombuffer(rows[i].unit, np.float32) for i in order]) if rows else np.zeros((0, self.dim), np.float32)
        asked = self.spark.sparkContext.broadcast((ids, unit))
        first = self.graph.join(starts.select(F.col("id").alias("s")), F.col("id") == F.col("s"), "left_semi")
        state = self.scratch.save(first.mapInArrow(_start, STATE), "state")
        asked_for = max(1, len(rows))
        for _ in range(hops):
            opened = state.mapInArrow(_frontier(beam), "q long, o long").join(self.lists, F.col("o") == F.col("node")).select("q", F.col("list"))
            fresh = opened.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("met"))  # at most beam lists
            fresh = state.select("q", "seen").join(fresh.withColumnRenamed("q", "p"), F.col("q") == F.col("p")).mapInArrow(_unseen, "q long, c long")
            scored = fresh.join(self.nodes, F.col("c") == F.col("id")).select("q", "c", "unit").mapInArrow(_score(asked), "q long, c long, s float")
            gained = scored.groupBy(F.col("q").alias("p")).agg(F.collect_list("c").alias("cs"), F.collect_list("s").alias("ss"))
            new = self.scratch.save(state.join(gained, F.col("q") == F.col("p"), "left").mapInArrow(_advance(beam, pool, k), STATE), "state")
            self.scratch.drop(state)
            state = new
            self.hops += 1
            if state.where("moved").count() <= SETTLED * asked_for:
                break
        asked.unpersist()
        return state


#: q; its best nodes, their similarity and whether they were opened; all nodes seen; whether its nearest changed in the last hop.
STATE = "q long, near binary, sim binary, open binary, seen binary, moved boolean"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = 0.0, 0
    for batch in batches:
        if batch.num_rows:
            total, n = total + _matrix(batch.column("unit")).sum(0, dtype=np.float64), n + batch.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["s", "n"])


def _states(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(_binary([r[i] for r in rows]) for i in range(1, 5)), pa.array([r[5] for r in rows], pa.bool_())], ["q", "near", "sim", "open", "seen", "moved"])


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near, sim = _arrays(batch.column("near"), np.int64), _arrays(batch.column("sim"), np.float32)
        yield _states([(q, n, s, np.zeros(len(n), np.uint8), np.append(n, q), True) for q, n, s in zip(batch.column("id").to_pylist(), near, sim, strict=True)])


def _due(open_: np.ndarray, beam: int) -> np.ndarray:
    return np.flatnonzero(open_ == 0)[:beam]


def _frontier(beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [n[_due(o, beam)] for n, o in zip(_arrays(batch.column("near"), np.int64), _arrays(batch.column("open"), np.uint8), strict=True)]
            q = np.repeat(batch.column("q").to_numpy(), [len(x) for x in near])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(near) if near else [], pa.int64())], ["q", "o"])

    return run


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        met = [np.setdiff1d(m.values.to_numpy(), s) for m, s in zip(batch.column("met"), _arrays(batch.column("seen"), np.int64), strict=True)]
        q = np.repeat(batch.column("q").to_numpy(), [len(x) for x in met])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(met) if met else [], pa.int64())], ["q", "c"])


def _score(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = asked.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                at = np.searchsorted(ids, part.column("q").to_numpy())
                s = np.einsum("ij,ij->i", unit[at], _matrix(part.column("unit")))
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("c"), pa.array(s, pa.float32())], ["q", "c", "s"])

    return run


def _advance(beam: int, pool: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            cols = [_arrays(batch.column(c), k) for c, k in (("near", np.int64), ("sim", np.float32), ("open", np.uint8), ("seen", np.int64))]
            for q, near, sim, opened, seen, c, s in zip(batch.column("q").to_pylist(), *cols, batch.column("cs"), batch.column("ss"), strict=True):
                opened = opened.copy()
                opened[_due(opened, beam)] = 1
                before = near[:k]
                if c.is_valid:
                    c, s = c.values.to_numpy(), s.values.to_numpy()
                    near, sim = np.append(near, c), np.append(sim, s)
                    opened, seen = np.append(opened, np.zeros(len(c), np.uint8)), np.append(seen, c)
                    order = np.lexsort((near, -sim))[:pool]
                    near, sim, opened = near[order], sim[order], opened[order]
                rows.append((q, near, sim, opened, seen, not np.array_equal(before, near[:k])))
            if rows:
                yield _states(rows)

    return run


def _first(k: int):
    """The k nearest, and all that rounding may have put behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, s in zip(_arrays(batch.column("near"), np.int64), _arrays(batch.column("sim"), np.float32), strict=True):
                near.append(x[s >= np.sort(s)[::-1][min(k, len(s)) - 1] - ROUNDING] if len(s) else x)
            q = np.repeat(batch.column("q").to_numpy(), [len(x) for x in near])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(near) if near else [], pa.int64())], ["q", "c"])

    return run


def _cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = _matrix(batch.column("x"), np.float64), _matrix(batch.column("y"), np.float64)
        s = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return index.search(F.col("id") % 50 == 0)
