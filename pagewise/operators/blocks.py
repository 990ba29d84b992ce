"""Blocks of queries against blocks of rows, as matrix products.

Queries and rows that agree on their keys are dealt in blocks; a cell holds one
block of each, and makes all of its pairs in tiles that never leave the task.
So what moves are rows, queries and what is made of a cell, but no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import LOG2E, array_of

#: Queries or rows of a key for which there is one more block: some 80 MB of rows, which a cell holds once.
BLOCK = 1 << 18
#: Blocks of rows that one cell takes where rows only pass through it, so that it needs no memory for them.
PASSED = 4
#: Elements of the vectors of rows that pass through which move at most (64 MB as floats). More stay where they are read, if they are of no more than this many keys.
MOVED, KEYS = 1 << 24, 64
#: Rows in one piece where rows stay, and the parts that they are read in there if queries are enough for all cores.
CHUNK, READ = 1 << 12, 2
#: Cells for each core that fewer rows are dealt into, over all keys, and the rows that one more of them takes.
PARTS, PART = 2, 1024
#: Pairs that are made at once (1 MB, so that they stay in a core's cache), and the most rows or queries of them.
TILE, TILE_ROWS, TILE_QUERIES = 1 << 17, 1024, 512
#: Rows for which a search has bounds of their own at most; a longer page is several.
PIECE = 64
#: Scores are told apart at six digits.
NEAR = 1e-6
STATES = "query_id long, head int, s double, o array<double>"


@dataclass
class Queries:
    id: np.ndarray
    head: np.ndarray
    slope: np.ndarray
    x: np.ndarray

    def at(self, s: slice) -> Queries:
        return Queries(self.id[s], self.head[s], self.slope[s], self.x[s])


@dataclass
class Rows:
    pos: np.ndarray
    page: np.ndarray
    x: np.ndarray
    v: np.ndarray


def cells(queries: DataFrame, rows: DataFrame, on: tuple[str, ...], dim: int, wide: int, work: Callable[[Queries, Rows], Iterator[pa.RecordBatch]], schema: str, slope: Column | None = None) -> DataFrame:
    """What ``work`` makes of each cell that has queries and rows.

    Queries have ``query_id``, ``head``, ``q`` and the keys ``on``; rows ``pos``, ``k``, the keys, ``v`` if
    ``wide`` of its elements are asked for, and ``page_id`` if a page's rows must lie in one cell. Elements
    that are null are NaN in vectors and 0 in ``v``.
    """
    held_of = _sizes(rows, on)
    blocks, parts = _grid(_sizes(queries, on), held_of, queries, BLOCK)
    keys = [f"__on{i}" for i in range(len(on))]
    paged = "page_id" in rows.columns
    number, deal, null = _number, _deal, _null
    vector = lambda c: array_of(f"coalesce({c}[{{i}}], double('NaN'))", dim).alias("x")
    of = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    asked = queries.select(*of, deal("query_id", blocks).alias("__q"), number(parts).alias("__r"), F.lit(True).alias("asks"), F.col("query_id").cast("long").alias("id"),
                           F.col("head").cast("int").alias("head"), (F.lit(0.0) if slope is None else slope).cast("double").alias("slope"), null("long").alias("page"), vector("q"), null("array<double>").alias("v"))
    page = F.col("page_id").cast("long") if paged else F.lit(0).cast("long")
    held = rows.select(*of, number(blocks).alias("__q"), deal("page_id" if paged else "pos", parts).alias("__r"), F.lit(False).alias("asks"), F.col("pos").cast("long").alias("id"),
                       null("int").alias("head"), null("double").alias("slope"), page.alias("page"), vector("k"), (array_of("coalesce(v[{i}], 0.0D)", wide) if wide else null("array<double>")).alias("v"))
    keys += ["__q", "__r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda s, c: s[c].to_numpy(zero_copy_only=False)
        grid = lambda s, c, n: s[c].flatten().to_numpy(zero_copy_only=False).reshape(len(s), n)
        asking, held = [], []
        for b in batches:
            q, r = b.filter(b["asks"]), b.filter(pc.invert(b["asks"]))
            if len(q):
                asking.append((flat(q, "id"), flat(q, "head"), flat(q, "slope"), grid(q, "x", dim)))
            if len(r):
                held.append((flat(r, "id"), flat(r, "page"), grid(r, "x", dim), grid(r, "v", wide) if wide else np.empty((len(r), 0))))
        if asking and held:
            joined = lambda parts, i: np.concatenate([p[i] for p in parts])
            q, r = (kind(*(joined(parts, i) for i in range(4))) for kind, parts in ((Queries, asking), (Rows, held)))
            asking.clear()
            held.clear()
            yield from work(q, r)

    return asked.unionByName(held).repartition(4 * max(1, held_of.keys) * blocks * parts, *keys).groupBy(*keys).applyInArrow(run, schema)


def passed(queries: DataFrame, rows: DataFrame, on: tuple[str, ...], dim: int, wide: int, slope: Column | None = None) -> DataFrame:
    """``query_id``, ``head``, ``s``, ``o``: states of all rows for each query, one from each part that its key's rows are dealt in.

    A cell's queries come first and stay with their states; its rows pass by a batch at a time. So memory sets
    no bound to a cell's rows, and queries and states are repeated as often as cores or a task's sort ask for.
    Columns are those of ``cells``. Vectors move as floats where these hold them exactly. Many rows do not move; see ``_read_again``.
    """
    asked_of, held_of = _sizes(queries, on), _sizes(rows, on)
    blocks, parts = _grid(asked_of, held_of, queries, PASSED * BLOCK)
    keys = [f"__on{i}" for i in range(len(on))]
    of = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]

    def vectors(*columns: tuple[str, int, str]) -> list[Column]:
        """All elements as floats, or else as doubles: if floats lose something, or one is null or of another length."""
        floats = [f"cast({c} as array<float>)" for c, _, _ in columns]
        exact = " and ".join(f"size({c}) = {n} and cast({f} as array<double>) = {c}" for f, (c, n, _) in zip(floats, columns, strict=True))
        doubles = [f"coalesce({c}[{i}], {none})" for c, n, none in columns for i in range(n)]
        return [F.expr(f"CASE WHEN {exact} THEN concat({', '.join(floats)}) END").alias("x"), F.expr(f"CASE WHEN {exact} THEN NULL ELSE array({', '.join(doubles)}) END").alias("x64")]

    k, q, v = ("k", dim, "double('NaN')"), ("q", dim, "double('NaN')"), ("v", wide, "0.0D")
    asking = [F.col("query_id").cast("long").alias("id"), F.col("head").cast("int").alias("head"), (F.lit(0.0) if slope is None else slope).cast("double").alias("slope"), *vectors(q)]
    holding = [F.col("pos").cast("long").alias("id"), _null("int").alias("head"), _null("double").alias("slope"), *vectors(k, v)]
    if held_of.all * blocks * (dim + wide) > MOVED and held_of.keys <= KEYS:
        return _read_again(queries.select(*of, *asking), rows.select(*of, F.col("pos").cast("long").alias("id"), *(F.col(c).cast("array<double>") for c in "kv")), keys, asked_of.all, dim, wide)
    asked = queries.select(*of, _deal("query_id", blocks).alias("__q"), _number(parts).alias("__r"), F.lit(True).alias("asks"), *asking)
    held = rows.select(*of, _number(blocks).alias("__q"), _deal("pos", parts).alias("__r"), F.lit(False).alias("asks"), *holding)
    keys += ["__q", "__r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, sums = None, [], None
        for batch in batches:
            for b in _runs(batch, keys):
                if (key := [b[c][0].as_py() for c in keys]) != cell:
                    if sums:
                        yield sums.batch()
                    cell, asking, sums = key, [], None
                q, r = b.filter(b["asks"]), b.filter(pc.invert(b["asks"]))
                if len(q):
                    asking.append((_flat(q, "id"), _flat(q, "head"), _flat(q, "slope"), _vectors(q, dim, 0)))
                if len(r) and asking:
                    sums = Sums(Queries(*(np.concatenate([p[i] for p in asking]) for i in range(4))), wide)
                    asking = []
                if len(r) and sums:
                    x = _vectors(r, dim, wide)
                    sums.add(_flat(r, "id"), x[:, :dim].copy(), x[:, dim:].copy())
        if sums:
            yield sums.batch()

    dealt = asked.unionByName(held).repartition(4 * max(1, held_of.keys) * blocks * parts, *keys)
    return dealt.sortWithinPartitions(*keys, F.desc("asks")).mapInArrow(run, STATES)


def _read_again(asked: DataFrame, held: DataFrame, keys: list[str], n_queries: int, dim: int, wide: int) -> DataFrame:
    """The same where rows do not move: each task has a part of the queries, with their states, and reads the rows itself.

    So what moves are queries, and a state of each from each part that rows are read in: a few, or more where queries
    are too few for all cores. The rows are read as often as there are parts of queries.
    """
    cores = PARTS * asked.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n_queries // BLOCK), min(-(-cores // READ), n_queries // PART + 1))
    packed = lambda df, *columns: T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), T.StructField("first", T.BooleanType()), *(T.StructField(c, T.BinaryType()) for c in ("piece", *columns, "x"))])
    q = asked.repartition(parts, *keys, "id", "head").mapInArrow(_packed(keys, ("id", "head", "slope"), lambda b: _vectors(b, dim, 0), None), packed(asked, "id", "head", "slope"))
    r = held.coalesce(-(-cores // parts)).mapInArrow(_packed(keys, ("id",), lambda b: np.hstack([_elements(b["k"], dim, np.nan), _elements(b["v"], wide, 0.0)]), CHUNK), packed(held, "id"))
    met = r.alias("r").join(q.alias("q").hint("shuffle_replicate_nl"), [F.col(f"r.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys])
    once = [F.when(F.col("r.first"), F.col(f"q.{c}")).alias(f"q_{c}") for c in ("id", "head", "slope", "x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, Sums] = {}
        for b in batches:
            get = lambda c, i, t=float: np.frombuffer(b[c][i].as_buffer(), t)  # noqa: B023, E731
            for i, piece in enumerate(b["piece"].to_pylist()):
                if piece not in sums:  # the first rows of a key bring the queries
                    sums[piece] = Sums(Queries(*(get(f"q_{c}", i, t).copy() for c, t in (("id", np.int64), ("head", np.int32), ("slope", float))), get("q_x", i).reshape(-1, dim)), wide)
                x = get("x", i).reshape(-1, dim + wide)
                sums[piece].add(get("id", i, np.int64), x[:, :dim].copy(), x[:, dim:].copy())
        while sums:
            yield sums.popitem()[1].batch()

    return met.select("r.id", "r.x", "q.piece", *once).mapInArrow(run, STATES)


def _packed(keys: list[str], columns: tuple[str, ...], vectors: Callable[[pa.RecordBatch], np.ndarray], most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a key as one, or as several of ``most``, with a name of its own: columns and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list] = {}
        begun = set()

        def piece(key: tuple) -> pa.RecordBatch:
            parts = waiting.pop(key)
            data = [uuid4().bytes, *(np.concatenate([p[i] for p in parts]).tobytes() for i in range(1, len(columns) + 2))]
            first = key not in begun
            begun.add(key)
            return pa.RecordBatch.from_arrays([*parts[0][0], pa.array([first]), *(pa.array([x], pa.binary()) for x in data)], [*keys, "first", "piece", *columns, "x"])

        for batch in batches:
            codes = np.stack([pc.dictionary_encode(batch[k], null_encoding="encode").indices.to_numpy() for k in keys], axis=1)
            whole = [*(_flat(batch, c) for c in columns), vectors(batch)]
            _, first, which = np.unique(codes, axis=0, return_index=True, return_inverse=True)
            for i, at in enumerate(first):
                own = which.ravel() == i
                key = tuple(batch[k][at].as_py() for k in keys)
                waiting.setdefault(key, []).append(([batch[k].slice(at, 1) for k in keys], *(c[own] for c in whole)))
                if most and sum(len(p[1]) for p in waiting[key]) >= most:
                    yield piece(key)
        for key in list(waiting):
            yield piece(key)

    return run


def _flat(s: pa.RecordBatch, c: str) -> np.ndarray:
    return s[c].to_numpy(zero_copy_only=False)


def _vectors(s: pa.RecordBatch, dim: int, wide: int) -> np.ndarray:
    """Of each row the elements in ``x``, floats, or else in ``x64``; the last ``wide`` are 0 where they are null."""
    n = dim + wide
    x, floats = np.empty((len(s), n)), s["x"].flatten()
    short = s["x"].is_valid().to_numpy(zero_copy_only=False)
    some = floats.to_numpy(zero_copy_only=False).reshape(-1, n).astype(float)
    if floats.null_count:  # they are NaN by now
        some[:, dim:][floats.is_null().to_numpy(zero_copy_only=False).reshape(-1, n)[:, dim:]] = 0
    x[short], x[~short] = some, s["x64"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return x


def _elements(c: pa.ListArray, n: int, none: float) -> np.ndarray:
    """The first ``n`` elements of each list, and ``none`` for what is null or not there."""
    x = np.full((len(c), n), none)
    whole = pc.fill_null(pc.equal(pc.list_value_length(c), n), False)
    right = whole.to_numpy(zero_copy_only=False)
    flat = (c if right.all() else c.filter(whole)).flatten()
    x[right] = (pc.fill_null(flat, none) if flat.null_count else flat).to_numpy(zero_copy_only=False).reshape(-1, n)
    for i in np.flatnonzero(~right):
        for j, e in enumerate((c[i].as_py() or [])[:n]):
            x[i, j] = none if e is None else e
    return x


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, sorted by keys, that agree on them."""
    if not len(batch):
        return
    codes = np.stack([pc.dictionary_encode(batch[c], null_encoding="encode").indices.to_numpy() for c in keys])
    starts = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)])
    for s, e in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
        yield batch.slice(s, e - s)


def _number(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _deal(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


@dataclass
class Sizes:
    #: Of the key that has the most, of all keys, and how many keys there are.
    most: int
    all: int
    keys: int


def _sizes(df: DataFrame, on: tuple[str, ...]) -> Sizes:
    most, all_, keys = df.groupBy(*on).count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    return Sizes(most or 0, all_ or 0, keys)


def _grid(asked: Sizes, held: Sizes, queries: DataFrame, most: int) -> tuple[int, int]:
    """Blocks of a key's queries, and parts of its rows with ``most`` in each.

    Each block of one side repeats the other side, so there are no more than memory or idle cores ask for.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return asked.most // BLOCK + 1, max(held.most // most + 1, min(-(-PARTS * cores // max(1, held.keys)), held.most // PART + 1))


def _pieces(page: np.ndarray, pos: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pages, or pieces of them of ``most`` rows, in tiles of about the same length: their ids and places of their rows, -1 beyond the last."""
    order = np.lexsort((pos, page))
    starts = np.flatnonzero(np.r_[True, np.diff(page[order]) != 0])
    ends = np.r_[starts[1:], len(page)]
    if most:
        cuts = [np.arange(s, e, most) for s, e in zip(starts, ends, strict=True)]
        starts = np.concatenate(cuts)
        ends = np.r_[starts[1:], len(page)]
    sizes = ends - starts
    by_size = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(by_size):
        n = max(1, int(np.searchsorted(sizes[by_size[i:]] * np.arange(1, len(by_size) - i + 1), TILE_ROWS, side="right")))
        own = by_size[i : i + n]
        at = np.arange(sizes[own].max())
        places = starts[own][:, None] + at
        inside = at < sizes[own][:, None]
        yield page[order[starts[own]]], np.where(inside, order[np.where(inside, places, 0)], -1)
        i += n


def _tiles(q: Queries, width: int) -> Iterator[slice]:
    n = min(TILE_QUERIES, max(16, TILE // max(1, width)))
    return (slice(i, i + n) for i in range(0, len(q.id), n))


def _lists(x: np.ndarray, nothing: np.ndarray) -> pa.ListArray:
    values = pa.array(x.ravel(), mask=np.repeat(nothing, x.shape[1]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), values)


def softmax(q: Queries, r: Rows, paged: bool, merged: bool) -> Iterator[pa.RecordBatch]:
    """States of the rows for each query: of each page, or of all; ``paged`` and ``merged``: of each page first and then of these."""
    if not paged:
        sums = Sums(q, r.v.shape[1])
        sums.add(r.pos, r.x, r.v)
        yield sums.batch()
        return
    biased = bool(q.slope.any())
    scaled = Queries(q.id, q.head, q.slope, q.x / np.sqrt(q.x.shape[1]) * (1 if biased else LOG2E))
    xs, vs, ps = np.vstack([r.x, np.full(r.x.shape[1], np.nan)]), np.vstack([r.v, np.zeros(r.v.shape[1])]), np.r_[r.pos, 0]
    odd = bool(np.isnan(q.x).any())
    top, mass, total = np.full(len(q.id), -np.inf), np.zeros(len(q.id)), np.zeros((len(q.id), r.v.shape[1]))
    for pages, at in _pieces(r.page, r.pos, None):
        k, v = xs[at], vs[at]
        lost = odd or bool(np.isnan(k).any())
        k = k.transpose(0, 2, 1)
        for s in _tiles(q, at.size):
            own = scaled.at(s)
            z = np.matmul(own.x[None], k)
            if biased:
                z += own.slope[None, :, None] * (ps[at][:, None, :] - own.id[None, :, None])
                z *= LOG2E
            if lost:
                z[np.isnan(z)] = -np.inf
            m = z.max(axis=2)
            z -= np.where(np.isneginf(m), 0.0, m)[:, :, None]
            np.exp2(z, out=z)
            d, o = z.sum(axis=2), np.matmul(z, v)
            if merged:
                new = np.maximum(top[s], m.max(axis=0))
                base = np.where(np.isneginf(new), 0.0, new)
                was, is_ = np.exp2(top[s] - base), np.exp2(m - base)
                mass[s] = mass[s] * was + (is_ * d).sum(axis=0)
                total[s] = total[s] * was[:, None] + np.einsum("pq,pqv->qv", is_, o)
                top[s] = new
            else:
                yield _state(np.tile(own.id, len(pages)), np.tile(own.head, len(pages)), m.ravel(), d.ravel(), o.reshape(-1, o.shape[2]), np.repeat(pages, len(own.id)))
    if merged:
        yield _state(q.id, q.head, top, mass, total, None)


class Sums:
    """States of rows for each query, rows taken as they come."""

    def __init__(self, q: Queries, wide: int):
        self.biased, self.odd = bool(q.slope.any()), bool(np.isnan(q.x).any())
        self.q = Queries(q.id, q.head, q.slope, np.empty((0, 0)))  # their vectors are kept scaled, and may lie in a batch that is large
        self.x = q.x / np.sqrt(q.x.shape[1]) * (1 if self.biased else LOG2E)
        self.top, self.mass, self.total = np.full(len(q.id), -np.inf), np.zeros(len(q.id)), np.zeros((len(q.id), wide))

    def add(self, pos: np.ndarray, k: np.ndarray, v: np.ndarray) -> None:
        lost = self.odd or bool(np.isnan(k).any())
        for s in _tiles(self.q, TILE_ROWS):
            x, top, mass, total = self.x[s], self.top[s], self.mass[s], self.total[s]
            for i in range(0, len(pos), TILE_ROWS):
                z = x @ k[i : i + TILE_ROWS].T
                if self.biased:
                    z += self.q.slope[s][:, None] * (pos[i : i + TILE_ROWS][None] - self.q.id[s][:, None])
                    z *= LOG2E
                if lost:
                    z[np.isnan(z)] = -np.inf
                new = np.maximum(top, z.max(axis=1))
                base = np.where(np.isneginf(new), 0.0, new)
                z -= base[:, None]
                np.exp2(z, out=z)
                was = np.exp2(top - base)
                mass[:] = mass * was + z.sum(axis=1)
                total[:] = total * was[:, None] + z @ v[i : i + TILE_ROWS]
                top[:] = new

    def batch(self) -> pa.RecordBatch:
        return _state(self.q.id, self.q.head, self.top, self.mass, self.total, None)


def _state(ids: np.ndarray, heads: np.ndarray, m: np.ndarray, d: np.ndarray, o: np.ndarray, pages: np.ndarray | None) -> pa.RecordBatch:
    nothing = d == 0
    d = np.where(nothing, 1.0, d)
    keys = {"query_id": pa.array(ids), "head": pa.array(heads.astype(np.int32))} | ({} if pages is None else {"page_id": pa.array(pages)})
    return pa.RecordBatch.from_pydict(keys | {"s": pa.array(m + np.log2(d), mask=nothing), "o": _lists(o / d[:, None], nothing)})


class Best:
    """The ``k`` rows of greatest score of each of ``n`` queries; of scores that are equal at six digits, those of the lower positions."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.query, self.pos, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, scores: np.ndarray, pos: np.ndarray) -> None:
        """Scores of all queries for the rows ``pos``."""
        n = scores.shape[1]
        if n > self.k and np.isneginf(self.floor).any():
            self.floor = np.maximum(self.floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k] - NEAR)
        query, i = np.nonzero(scores >= self.floor[:, None])
        self.put(query, pos[i], scores[query, i])

    def put(self, query: np.ndarray, pos: np.ndarray, score: np.ndarray) -> None:
        query, pos, score = np.r_[self.query, query], np.r_[self.pos, pos], np.r_[self.score, score]
        order = np.lexsort((pos, -np.round(score, 6), query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.query, self.pos, self.score = query[kept], pos[order][kept], score[order][kept]
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[order][last] - NEAR)

    def batch(self, q: Queries) -> pa.RecordBatch:
        nothing = np.isneginf(self.score)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(q.id[self.query]), "head": pa.array(q.head[self.query].astype(np.int32)), "pos": pa.array(self.pos), "score": pa.array(self.score, mask=nothing)})


def _scores(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    z = x @ k.T
    if np.isnan(z.sum()):
        z[np.isnan(z)] = -np.inf
    return z


def nearest(q: Queries, r: Rows, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best rows of the cell for each query."""
    order = np.argsort(r.pos)
    pos, x = r.pos[order], r.x[order]
    for s in _tiles(q, TILE_ROWS):
        own, best = q.at(s), Best(len(q.id[s]), k)
        for i in range(0, len(pos), TILE_ROWS):
            best.add(_scores(own.x, x[i : i + TILE_ROWS]), pos[i : i + TILE_ROWS])
        yield best.batch(own)


def pruned(q: Queries, r: Rows, k: int, first: int) -> Iterator[pa.RecordBatch]:
    """The same from those pages only whose digest leaves them a chance.

    The ``first`` pages of greatest bound of each query are scored, and then every page whose bound is
    not under the k-th score of these: one by one where they are few, and else, of all the queries
    of a tile, those that any of them asks for.
    """
    tiles = [(at, xs) for _, at in _pieces(r.page, r.pos, PIECE) for xs in [np.where((at < 0)[:, :, None], np.nan, r.x[at])]]
    long = max(at.shape[1] for at, _ in tiles)
    at = np.concatenate([np.pad(a, ((0, 0), (0, long - a.shape[1])), constant_values=-1) for a, _ in tiles])
    x = np.concatenate([np.pad(b, ((0, 0), (0, long - b.shape[1]), (0, 0)), constant_values=np.nan) for _, b in tiles])
    hi, lo = np.fmax.reduce(x, axis=1), np.fmin.reduce(x, axis=1)
    blank = np.isnan(x).any(axis=2).all(axis=1) | np.isnan(hi).any(axis=1)  # no bound: always scored
    hi, lo = np.nan_to_num(hi), np.nan_to_num(lo)
    inside = at >= 0
    del tiles
    piece_of = np.empty(len(r.pos), np.int64)
    piece_of[at[inside]] = np.nonzero(inside)[0]
    for s in _tiles(q, max(TILE_ROWS, len(at) // 8)):
        own, best = q.at(s), Best(len(q.id[s]), k)
        asked = np.nan_to_num(own.x)
        bound = np.maximum(asked, 0) @ hi.T + np.minimum(asked, 0) @ lo.T
        bound[:, blank] = np.inf
        bound[np.isnan(own.x).any(axis=1)] = np.inf
        n = min(first, len(at))
        near = np.argpartition(-bound, n - 1, axis=1)[:, :n]
        z = np.matmul(x[near].reshape(len(own.id), n * long, -1), own.x[:, :, None])[:, :, 0]
        z[np.isnan(z)] = -np.inf
        if z.shape[1] >= k:
            best.floor = np.partition(z, z.shape[1] - k, axis=1)[:, z.shape[1] - k] - NEAR
        open_ = bound >= best.floor[:, None]
        if 16 * open_.sum() < open_.size:
            query, piece = np.nonzero(open_)
            z = np.matmul(x[piece], own.x[query][:, :, None])[:, :, 0]
            z[np.isnan(z)] = -np.inf
            i, j = np.nonzero((z >= best.floor[query][:, None]) & inside[piece])
            best.put(query[i], r.pos[at[piece[i], j]], z[i, j])
        else:
            asked_for = open_.any(axis=0)
            rows = None if asked_for.all() else np.flatnonzero(asked_for[piece_of])
            for i in range(0, len(r.pos) if rows is None else len(rows), TILE_ROWS):
                some = slice(i, i + TILE_ROWS) if rows is None else rows[i : i + TILE_ROWS]
                best.add(_scores(own.x, r.x[some]), r.pos[some])
        yield best.batch(own)
