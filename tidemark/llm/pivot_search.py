"""2. Exact top-k search by inner product: pivot-table elimination.

Components are scaled to integers, so scores are exact. Vectors stand in blocks of ``block`` rows of one dimension, as
bytes. A block's pivot table has its rows' distances to ``pivots`` pivots of the dimension (vectors with the smallest id
hashes in some blocks); its rows are put in the order of their nearest pivot and cut into slabs, of which the smallest
and largest distance to each pivot are kept. For a query q and a slab the triangle inequality over all pivots gives the
maximum lower bound of the distance to any x in it, hence an upper bound of <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2.
Slabs are searched in bound order; a query leaves out those whose bound is below the k-th best score found. In a slab
that stays, one product of matrices in single precision tells which candidates can reach the k-th best score, rounding
allowed for, and these are evaluated exactly. Of equal vectors in a block only the k + 1 first can be results.

A first pass searches a few blocks for all queries: the k-th scores found there are the thresholds of the second pass,
whose tasks each hold a group of queries, through which a part of the blocks streams; the best k of a query are carried
from block to block. So blocks are copied once for each group (8 million components) and queries once for each part,
never blocks with blocks, and a task gives at most k rows for each query.

Cases: vectors that are null or empty or hold null or non-finite components take no part, nor do rows without an id;
vectors of other dimensions than the query's are no candidates; ties go to the smaller id. Rows count as rows: of rows
that repeat an id each is a candidate of the others, and each that is a query has results of its own, alike but for
the row left out. A query with fewer than k candidates gets all. Scaled components and scores beyond 64 bits count as
the nearest number of 64 bits. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix, small, written

#: Integers up to here are exact as doubles, and so are sums of products that stay below.
EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)

#: Components that a group of queries and a block hold at most, and rows of a slab and of queries searched at once.
GROUP, BLOCK, SLAB, AT_ONCE = 1 << 23, 1 << 21, 512, 1024

_PACKED = "dim int, uid bigint, n int, asked int, rows binary, ids binary, vectors binary, asks binary"


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``id, v array<double>``: floor(scale * component) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("x")).where("id is not null and size(x) > 0").where(whole)
    return kept.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def table_of(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to the pivots."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def rounding(dim: int) -> float:
    """What a distance in a table, kept in single precision, can be off by, as a share of both norms."""
    return ((dim + 8) * 2.0**-51) ** 0.5 + 2.0**-21


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest of three types that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // (n * dim)]).reshape(n, dim)


class _Packer:
    """Rows of one dimension, gathered into blocks: records of ``_PACKED``."""

    def __init__(self, rows: int):
        self.rows, self.held, self.size, self.components = rows, defaultdict(list), defaultdict(int), 0

    def add(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
        dim = x.shape[1]
        most = max(1, min(self.rows, BLOCK // dim))
        while len(rows):
            m = most - self.size[dim]
            self.held[dim].append((rows[:m], ids[:m], x[:m], asks[:m]))
            self.size[dim] += len(rows[:m])
            self.components += dim * len(rows[:m])
            rows, ids, x, asks = rows[m:], ids[m:], x[m:], asks[m:]
            if self.size[dim] == most:
                yield self.block(dim)
        if self.components > 4 * BLOCK:  # many dimensions
            yield from self.rest()

    def block(self, dim: int) -> pa.RecordBatch:
        rows, ids, x, asks = (np.concatenate(c) for c in zip(*self.held.pop(dim), strict=True))
        self.components -= dim * self.size.pop(dim)
        x = np.ascontiguousarray(_narrow(x))
        one = {"dim": dim, "uid": int(rows[0]), "n": len(rows), "asked": int(asks.sum()), "rows": rows.tobytes(), "ids": ids.tobytes(), "vectors": x.tobytes(), "asks": asks.tobytes()}
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one.values(), types, strict=True)], list(one))

    def rest(self) -> Iterator[pa.RecordBatch]:
        for dim in list(self.held):
            yield self.block(dim)


def packed(vectors: DataFrame, is_query: Column, block: int) -> DataFrame:
    """Blocks of the rows of each partition; ``rows`` are numbers of the rows, which hold for what is written of this only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, row = _Packer(block), TaskContext.get().partitionId() << 33
        for batch in batches:
            v, asks = batch.column("v"), batch.column("asks").fill_null(False).to_numpy(zero_copy_only=False)
            ids, size = batch.column("id").to_numpy(), v.value_lengths().to_numpy()
            rows = row + np.arange(batch.num_rows)
            row += batch.num_rows
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = (v if len(at) == len(size) else v.take(pa.array(at))).flatten().to_numpy()
                yield from packer.add(rows[at], ids[at], x.reshape(-1, dim), asks[at])
        yield from packer.rest()

    return vectors.select("id", "v", is_query.alias("asks")).mapInArrow(run, _PACKED)


def _asking(blocks: DataFrame, query_block: int) -> DataFrame:
    """The queries among the rows of blocks, in blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(query_block)
        for batch in batches:
            for one in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(one["asks"], bool))
                x = _matrix(one["vectors"], one["n"], one["dim"])[at]
                yield from packer.add(np.frombuffer(one["rows"], np.int64)[at], np.frombuffer(one["ids"], np.int64)[at], x, np.ones(len(at), bool))
        yield from packer.rest()

    return blocks.where("asked > 0").mapInArrow(run, _PACKED)


def _pivots(blocks: DataFrame, pivots: int) -> DataFrame:
    """``dim, pivots array<binary>``: the vectors with the smallest id hashes in the given blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                h = mix(np.frombuffer(one["ids"], np.uint64) + np.uint64(5)).view(np.int64)
                at = np.argsort(h, kind="stable")[:pivots]
                x = _matrix(one["vectors"], one["n"], one["dim"])[at].astype(np.float64)
                columns = [pa.array([one["dim"]] * len(at), pa.int32()), pa.array(h[at]), pa.array(np.frombuffer(one["rows"], np.int64)[at]), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "h", "row", "v"])

    near = blocks.select("dim", "n", "rows", "ids", "vectors").mapInArrow(run, "dim int, h bigint, row bigint, v binary")
    order = F.row_number().over(Window.partitionBy("dim").orderBy("h", "row"))
    return near.withColumn("at", order).where(F.col("at") <= pivots).groupBy("dim").agg(F.collect_list("v").alias("pivots"))


class Candidates:
    """A block of vectors with its pivot table, in slabs."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int, slab: int = SLAB):
        at = self.first(rows, ids, x, k)
        x = x[at].astype(np.float64)
        table = table_of(x, pivots)
        near = table.argmin(1)
        order = np.lexsort((table[np.arange(len(x)), near], near))
        self.rows, self.ids, self.x, table = rows[at][order], ids[at][order], x[order], table[order]
        x2 = (self.x * self.x).sum(1)
        self.most, self.norm = np.abs(x).max(initial=0), float(np.sqrt(x2.max())) or 1.0
        self.single = (self.x / self.norm).astype(np.float32)
        self.starts = np.arange(0, len(x), slab)
        off = 2 * rounding(x.shape[1]) * np.sqrt((pivots * pivots).sum(1))  # of both tables, by the pivot's norm
        self.low, self.high = (np.minimum.reduceat(table, self.starts) - off).astype(np.float32), (np.maximum.reduceat(table, self.starts) + off).astype(np.float32)
        self.x2 = np.maximum.reduceat(x2, self.starts)
        self.slab = slab

    @staticmethod
    def first(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """All but those that k + 1 equal vectors with smaller (id, row) precede: one may be the query itself."""
        keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
        h = (x.astype(np.float64) * (1.0 + np.arange(x.shape[1]) % 7)).sum(1)
        if np.unique(h, return_counts=True)[1].max() <= k + 1:
            return np.arange(len(x))
        _, group = np.unique(keys, return_inverse=True)
        order = np.lexsort((rows, ids, group))
        begun = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
        at = np.arange(len(x)) - np.repeat(begun, np.diff(np.r_[begun, len(x)]))
        return np.sort(order[at <= k])


class Queries:
    """Queries with the best candidates found so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, least: np.ndarray, pivots: np.ndarray, k: int):
        self.rows, self.ids, self.x, self.least, self.k = rows, ids, x, least, k
        n, self.norm, self.table = len(rows), np.empty(len(rows)), np.empty((len(pivots), len(rows)), np.float32)
        self.single, self.most = np.empty(x.shape, np.float32), 0.0
        for a in range(0, n, AT_ONCE):  # wide numbers of some rows only at once
            v = x[a : a + AT_ONCE].astype(np.float64)
            self.most = max(self.most, np.abs(v).max())
            norm = np.sqrt((v * v).sum(1))
            self.norm[a : a + AT_ONCE] = np.where(norm > 0, norm, 1)
            self.single[a : a + AT_ONCE] = v / self.norm[a : a + AT_ONCE, None]
            self.table[:, a : a + AT_ONCE] = table_of(v, pivots).T
        self.count, self.score, self.found = np.zeros(n, np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.room = np.empty(0, np.float32)
        self.waiting, self.margin = {a: [] for a in range(0, n, AT_ONCE)}, (x.shape[1] + 8) * 2.0**-22

    def search(self, c: Candidates) -> None:
        for a in range(0, len(self.rows), AT_ONCE):
            self._search(a, min(a + AT_ONCE, len(self.rows)), c)

    def _search(self, a: int, e: int, c: Candidates) -> None:
        low, far = np.zeros((len(c.starts), e - a), np.float32), np.empty((len(c.starts), e - a), np.float32)
        for p in range(len(self.table)):
            t = self.table[p, a:e]
            np.maximum(low, np.subtract(t, c.high[:, p, None], out=far), out=low)
            np.maximum(low, np.subtract(c.low[:, p, None], t, out=far), out=low)
        size = self.norm[a:e] ** 2 + c.x2[:, None]
        low = np.maximum(low - 1e-6 * (1 + low) - 2 * rounding(self.x.shape[1]) * np.sqrt(size), 0)  # rounding can't lift it above the true bound
        bound = (size - low * low) / 2
        bound += 1e-9 * (np.abs(bound) + size) + 1e-3
        bound = np.maximum(bound, float(_LONG[0]))  # as scores are
        for s in np.argsort(-bound.max(1), kind="stable"):
            stay = np.flatnonzero(bound[s] >= self.least[a:e])
            if len(stay):
                self._slab(a, stay + a, c, slice(c.starts[s], c.starts[s] + c.slab), len(stay) == e - a)

    def _slab(self, a: int, at: np.ndarray, c: Candidates, cut: slice, whole: bool) -> None:
        x = c.single[cut]
        if len(self.room) < len(at) * len(x):
            self.room = np.empty(len(at) * len(x), np.float32)
        product = self.room[: len(at) * len(x)].reshape(len(at), len(x))
        np.matmul(self.single[a : a + len(at)] if whole else self.single[at], x.T, out=product)
        new = np.flatnonzero(self.least[at] == -np.inf)
        if len(new):  # the best of this slab are taken first
            self._merge(a)
            m = min(self.k + 1, product.shape[1])
            best = np.argpartition(-product[new], m - 1, axis=1)[:, :m]
            self._take(a, np.repeat(at[new], m), best.ravel() + cut.start, c)
            product[new[:, None], best] = -np.inf
            self._merge(a)
        far = self.least[at] / (self.norm[at] * c.norm) - self.margin
        far = np.maximum(far, -1e30).astype(np.float32)  # those taken are below
        hit = np.flatnonzero(product.max(1) >= far)
        if len(hit):
            i, j = np.nonzero(product[hit] >= far[hit, None])
            self._take(a, at[hit[i]], j + cut.start, c)
            if sum(len(i) for i, _, _ in self.waiting[a]) >= 2 * AT_ONCE:
                self._merge(a)

    def _take(self, a: int, i: np.ndarray, j: np.ndarray, c: Candidates) -> None:
        """Exact scores of pairs wait to be merged."""
        other = self.rows[i] != c.rows[j]
        i, j = i[other], j[other]
        for b in range(0, len(i), 1 << 16):
            at, to = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            if self.most * c.most * self.x.shape[1] < EXACT:
                s = np.einsum("ij,ij->i", self.x[at].astype(np.float64), c.x[to]).astype(np.int64)
            else:  # integers of any size where doubles don't hold them
                whole = [sum(int(v) * int(w) for v, w in zip(q, x, strict=True)) for q, x in zip(self.x[at].tolist(), c.x[to].tolist(), strict=True)]
                s = np.array([min(max(v, _LONG[0]), _LONG[1]) for v in whole], np.int64)
            reach = s >= self.least[at]
            self.waiting[a].append((at[reach], s[reach], c.ids[to[reach]]))

    def _merge(self, a: int) -> None:
        """What waits goes among the best, and thresholds rise."""
        if not self.waiting[a]:
            return
        i, s, d = (np.concatenate(v) for v in zip(*self.waiting[a], strict=True))
        self.waiting[a] = []
        touched = np.unique(i)
        had = np.arange(self.k) < self.count[touched, None]
        i = np.concatenate([np.repeat(touched, self.count[touched]), i])
        s, d = np.concatenate([self.score[touched][had], s]), np.concatenate([self.found[touched][had], d])
        order = np.lexsort((d, ~s, i))
        i, s, d = i[order], s[order], d[order]
        begun = np.flatnonzero(np.r_[True, np.diff(i) > 0])
        rank = np.arange(len(i)) - np.repeat(begun, np.diff(np.r_[begun, len(i)]))
        kept = rank < self.k
        self.score[i[kept], rank[kept]], self.found[i[kept], rank[kept]] = s[kept], d[kept]
        self.count[touched] = np.add.reduceat(kept.astype(np.int64), begun)
        full = touched[self.count[touched] == self.k]
        least = self.score[full, -1]
        self.least[full] = np.maximum(self.least[full], np.where(least == _LONG[0], -np.inf, least))

    def end(self) -> None:
        for a in self.waiting:
            self._merge(a)


def _searched(met: DataFrame, k: int, thresholds: bool) -> DataFrame:
    """``met``: queries (side 0) and then blocks (side 1) of each key. (query row, id, candidate, score), or the blocks of queries with their k-th scores."""
    key = ("dim", "part", "grp")

    def ended(q: Queries, held: list[dict]) -> Iterator[pa.RecordBatch]:
        q.end()
        if thresholds:
            a = 0
            for one in held:
                columns = [pa.array([one["dim"]], pa.int32()), pa.array([one["uid"]], pa.int64()), pa.array([q.least[a : a + one["n"]].tobytes()], pa.binary())]
                a += one["n"]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "uid", "least"])
            return
        for a in range(0, len(q.rows), AT_ONCE):
            n = q.count[a : a + AT_ONCE]
            had = np.arange(k) < n[:, None]
            columns = [np.repeat(q.rows[a : a + AT_ONCE], n), np.repeat(q.ids[a : a + AT_ONCE], n), q.found[a : a + AT_ONCE][had], q.score[a : a + AT_ONCE][had]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q_row", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, q, pivots = None, [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if now != (this := tuple(one[c] for c in key)):
                    if held:
                        yield from ended(q or _queries(held, pivots, k), held)
                    now, held, q, pivots = this, [], None, None
                if one["side"] == 0:
                    if pivots is None:
                        pivots = np.frombuffer(b"".join(one["pivots"]), np.float64).reshape(-1, one["dim"])
                    held.append({**one, "pivots": None})
                elif held:
                    if q is None:
                        q = _queries(held, pivots, k)
                        held = [{c: one[c] for c in ("dim", "uid", "n")} for one in held]
                    q.search(Candidates(np.frombuffer(one["rows"], np.int64), np.frombuffer(one["ids"], np.int64), _matrix(one["vectors"], one["n"], one["dim"]), pivots, k))
        if held:
            yield from ended(q or _queries(held, pivots, k), held)

    return met.mapInArrow(run, "dim int, uid bigint, least binary" if thresholds else "q_row bigint, query_id bigint, vec_id bigint, score bigint")


def _queries(held: list[dict], pivots: np.ndarray, k: int) -> Queries:
    rows, ids = (np.concatenate([np.frombuffer(one[c], np.int64) for one in held]) for c in ("rows", "ids"))
    least = np.concatenate([np.frombuffer(one["least"], np.float64) if one["least"] else np.full(one["n"], -np.inf) for one in held])
    return Queries(rows, ids, np.concatenate([_matrix(one["vectors"], one["n"], one["dim"]) for one in held]), least, pivots, k)


def _met(q: DataFrame, x: DataFrame, tasks: int) -> DataFrame:
    """Queries and blocks by key, each key's queries first; ``number`` deals keys to tasks."""
    columns = ["dim", "part", "grp", "uid", "n", "rows", "ids", "vectors"]
    sides = q.select("number", *columns, "least", "pivots", F.lit(0).alias("side")).unionByName(x.select("number", *columns, F.lit(1).alias("side")), allowMissingColumns=True)
    number = F.pmod(F.hash("dim").cast("bigint") + F.col("number"), F.lit(tasks)).cast("int")
    return sides.repartitionById(tasks, number).drop("number").sortWithinPartitions("dim", "part", "grp", "side", "uid")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 32, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (``id, v``) that is a query its k best others."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = written(packed(vectors, is_query, block), "blocks")
    asking = written(_asking(blocks, query_block), "asking")
    # rows of these tables are blocks and dimensions
    of_dim = Window.partitionBy("dim")
    seen = F.sum("n").over(of_dim.orderBy("uid")) - 1
    group = F.greatest(F.lit(1), F.floor(F.lit(GROUP) / F.col("dim")))
    q_at = asking.select("dim", "uid", F.floor(seen / group).cast("int").alias("grp"), F.floor(seen / (4 * query_block)).cast("int").alias("early"))
    groups = q_at.groupBy("dim").agg((F.max("grp") + 1).alias("groups"), (F.max("early") + 1).alias("earlies"))
    numbered = blocks.select("dim", "uid", "n", (F.row_number().over(of_dim.orderBy(F.xxhash64("uid"), "uid")) - 1).alias("at"), F.count("*").over(of_dim).alias("blocks"))
    parts = F.least("blocks", F.greatest(F.lit(6 * cores), F.ceil(F.col("blocks") / 64))).cast("int")
    x_at = numbered.join(small(groups), "dim").select("dim", "uid", "n", "at", "groups", "earlies", parts.alias("parts"), (F.col("at") < F.least(F.lit(16), F.ceil(F.col("blocks") / 64))).alias("first"))
    x_at = written(x_at, "numbers")
    dims = x_at.groupBy("dim").agg(F.first("parts").alias("parts"), F.first("groups").alias("groups"), F.first("earlies").alias("earlies"))
    n, early = dims.agg(F.sum(F.col("parts") * F.col("groups")), F.sum("earlies")).first()
    tasks = lambda keys: min(keys or 1, 100 * cores)
    x = blocks.drop("n", "asks").join(small(x_at), ["dim", "uid"])
    chosen = written(_pivots(x.where("first"), pivots), "pivots")
    q = asking.drop("asks").join(small(q_at), ["dim", "uid"]).join(small(dims), "dim").join(small(chosen), "dim")
    to = lambda last: F.explode(F.sequence(F.lit(0), F.col(last) - 1))
    first = _met(
        q.withColumns({"part": F.lit(0), "grp": F.col("early"), "number": F.col("early"), "least": F.lit(None).cast("binary")}),
        x.where("first").withColumn("part", F.lit(0)).withColumn("grp", to("earlies")).withColumn("number", F.col("grp")),
        tasks(early),
    )
    least = written(_searched(first, k, True), "thresholds")
    number = F.col("part") * F.col("groups") + F.col("grp")
    every = _met(
        q.join(least, ["dim", "uid"]).withColumn("part", to("parts")).withColumn("number", number),
        x.withColumn("part", F.col("at") % F.col("parts")).withColumn("grp", to("groups")).withColumn("number", number),
        tasks(n),
    )
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return _searched(every, k, False).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
