"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to unit length and rotated pseudo-randomly (three rounds of random signs and a fast Hadamard
transform); the signed axis nearest to it is its hash. A table's bucket is made of several such hashes. Every vector is
put into one bucket of each table; a query looks into its own bucket and, by least loss, into further ones (multiprobe).
Candidates are ranked exactly: Euclidean distance of the original vectors in double precision.

Equal vectors form a class: of a class only the k + 1 smallest ids can be among the k nearest of a query, so only those
are put into buckets, and equal queries are searched once. The hashes of a bucket follow from the number of rows, the
probes of a query from a sample: SAMPLE rows are searched exactly, and the probes are as many as it takes to find
AIM of their neighbours. Queries and rows meet by bucket in units of about UNIT_KEYS keys, of which a task holds one at a
time with the k + 1 best of each query, so no candidate list leaves it. A bucket of many rows is split, and queries probe
all its parts.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do null ids;
vectors of another length never meet; ties go to the smaller id; rows with equal ids count once; a query that finds fewer
than k in its buckets is ranked against all rows, so that a list is short only if there are fewer; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardinal.llm.columnar import by_unit, map_batches, mix, shuffle_partitions, unit_of, units_for
from cardinal.llm.staging import dropped, heavy_keys, join_split, staged

#: Tables; hashes of a bucket as long as an average one has BUCKET_ROWS rows or fewer; the most probes of a table, and the signed axes among which they are looked for.
TABLES, BUCKET_ROWS, PROBES, AXES = 16, 64, 2000, 64
#: Rows that are searched exactly to choose the number of probes, and the recall aimed at on them.
SAMPLE, AIM = 64, 0.96
#: Rows of a bucket from which it is split, and rows of a part.
HOT_ROWS = 8192
UNIT_KEYS = 1 << 20
PAIRS = 1 << 17
#: Queries that meet a block of rows at a time where all rows are ranked.
QUERY_BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (a power of two long), scaled to keep lengths."""
    n = x.shape[-1]
    step = 1
    while step < n:
        y = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        step *= 2
    return x / math.sqrt(n)


@lru_cache(maxsize=4)
def signs(size: int, rotations: int) -> np.ndarray:
    return np.random.default_rng(size * 1_000_003 + 7).choice((-1.0, 1.0), (rotations, 3, size))


def rotate(unit: np.ndarray, rotation: int, rotations: int) -> np.ndarray:
    size = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    for s in signs(size, rotations)[rotation]:
        x = hadamard(x * s)
    return x


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _key(table: int, codes: list[np.ndarray], axes: int) -> np.ndarray:
    key = np.full(codes[0].shape, table, np.int64)
    for c in codes:
        key = key * axes + c
    return key


def buckets(vectors: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """(rows, tables) of bucket keys."""
    unit, out = unit_vectors(vectors), []
    for t in range(tables):
        codes = []
        for h in range(hashes):
            x = rotate(unit, t * hashes + h, tables * hashes)
            axis = np.abs(x).argmax(1)
            codes.append(2 * axis + (x[np.arange(len(x)), axis] < 0))
        out.append(_key(t, codes, 2 * x.shape[1]))
    return np.stack(out, 1)


def probes(vectors: np.ndarray, tables: int, hashes: int, count: int = PROBES, axes: int = AXES) -> np.ndarray:
    """(rows, tables, probes) of bucket keys, by growing loss; the first is the own bucket."""
    unit, out = unit_vectors(vectors), []
    for t in range(tables):
        losses, codes = None, None
        for h in range(hashes):
            x = rotate(unit, t * hashes + h, tables * hashes)
            both = np.stack((x, -x), 2).reshape(len(x), -1)
            top = np.argsort(-both, 1, kind="stable")[:, : min(axes, both.shape[1])]
            value = np.take_along_axis(both, top, 1)
            loss = (value[:, :1] - value) ** 2
            if losses is None:
                losses, codes = loss, [top]
            else:
                losses = (losses[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
                wide = losses.shape[1] // top.shape[1]
                codes = [np.repeat(c, top.shape[1], 1) for c in codes] + [np.tile(top, (1, wide))]
            best = np.argsort(losses, 1, kind="stable")[:, :count]
            losses, codes = np.take_along_axis(losses, best, 1), [np.take_along_axis(c, best, 1) for c in codes]
        out.append(_key(t, codes, both.shape[1]))
    return np.stack(out, 1)


def _matrix(blobs: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length as a matrix of doubles."""
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)


def hashes_for(rows: int, size: int) -> int:
    """Hashes of a bucket: one more while an average bucket would have over BUCKET_ROWS rows. size: components of a vector."""
    axes, hashes = 2 << max(1, (size - 1).bit_length()), 2
    while rows > BUCKET_ROWS * axes**hashes:
        hashes += 1
    return hashes


def _split(keys: np.ndarray, hot: tuple[np.ndarray, np.ndarray], ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) with hot buckets (keys in order, parts) split: a row goes to the part of its id, a query (without ids) to all."""
    flat, place = keys.ravel(), np.repeat(np.arange(len(keys)), keys.shape[1])
    if not len(hot[0]):
        return place, mix(flat.view(np.uint64))
    at = np.minimum(np.searchsorted(hot[0], flat), len(hot[0]) - 1)
    parts = np.where(hot[0][at] == flat, hot[1][at], 1)
    if ids is not None:
        part = mix(ids.view(np.uint64))[place] % parts.astype(np.uint64)
    else:
        place, flat = np.repeat(place, parts), np.repeat(flat, parts)
        part = (np.arange(len(flat)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.uint64)
    return place, mix(flat.view(np.uint64) ^ mix(part + np.uint64(1)))


def _dealt(place: np.ndarray, key: np.ndarray, units: int, kind: int, ids: np.ndarray, blobs: list[bytes]) -> Iterator[dict]:
    """For each vector and unit that some of its keys belong to: one row with those keys."""
    unit = unit_of(key, units)
    order = np.lexsort((unit, place))
    place, key, unit = place[order], key[order], unit[order]
    cuts = np.append(np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (unit[1:] != unit[:-1]))), len(key))
    for at in range(0, len(cuts) - 1, 4096):
        ends = cuts[at : at + 4097]
        row = place[ends[:-1]]
        yield {
            "unit": unit[ends[:-1]], "kind": np.full(len(row), kind, np.int32), "id": ids[row],
            "keys": [key[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], "vector": pa.array([blobs[r] for r in row], pa.binary()),
        }


class Best:
    """The k nearest of each query so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.limit = k, [], 0, 1 << 20

    def add(self, query: np.ndarray, row: np.ndarray, distance: np.ndarray) -> None:
        self.parts.append((query, row, distance))
        self.size += len(query)
        if self.size > self.limit:
            self.parts = [self.best()]
            self.size = len(self.parts[0][0])
            self.limit = max(self.limit, 2 * self.size)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, row, distance = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((row, distance, query))
        query, row, distance = query[order], row[order], distance[order]
        fresh = np.append(True, (query[1:] != query[:-1]) | (row[1:] != row[:-1]))
        query, row, distance = query[fresh], row[fresh], distance[fresh]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        return query[rank < self.k], row[rank < self.k], distance[rank < self.k]


def _packed(rows: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, packed vector) of the rows that take part."""

    def kernel(batch):
        lists = batch.column(1)
        size = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)  # null is nan, -0 is 0
        ok = np.ones(len(lists), bool)
        owner = np.repeat(np.arange(len(lists)), size)
        ok[owner[~np.isfinite(values)]] = False
        ok &= np.bincount(owner[values != 0], minlength=len(lists)) > 0
        cuts = np.append(0, np.cumsum(size))
        at = np.flatnonzero(ok)
        yield {"id": batch.column(0).take(pa.array(at)), "vector": [values[cuts[i] : cuts[i + 1]].tobytes() for i in at]}

    good = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    return map_batches(good, kernel, "id bigint, vector binary")


def probe_count_for(index: DataFrame, kind: str, k: int, tables: int, hashes_of: dict[int, int]) -> int:
    """The probes of a table with which AIM of the k neighbours of SAMPLE rows are found, PROBES at most."""
    sample = staged(index.orderBy(F.xxhash64("id")).limit(SAMPLE).select(F.col("id").alias("leader"), "vector"))
    n = sample.count()
    if not n:
        return 1
    best = Window.partitionBy("leader").orderBy("score", "vec_id")
    near = against_all(sample, n, index, kind, k).where("leader != vec_id").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    near = near.select("leader", F.col("vec_id").alias("id")).join(index.select("id", "vector"), "id").select("leader", F.col("vector").alias("near"))
    found = staged(near.join(sample, "leader")).select("vector", "near").collect()  # SAMPLE * k rows at most
    dropped(sample)
    first = []
    for size in {len(r["vector"]) for r in found}:
        rows = [r for r in found if len(r["vector"]) == size]
        of = list({r["vector"]: None for r in rows})
        listed = dict(zip(of, probes(_matrix(of, kind), tables, hashes_of[size]), strict=True))
        own = buckets(_matrix([r["near"] for r in rows], kind), tables, hashes_of[size])
        for r, keys in zip(rows, own, strict=True):
            same = listed[r["vector"]] == keys[:, None]
            first.append(int(np.where(same.any(1), same.argmax(1), PROBES).min()))
    first = np.sort(first)
    return int(min(PROBES, first[max(0, math.ceil(AIM * len(first)) - 1)] + 1)) if len(first) else 1


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tables: int = TABLES, probe_count: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (distance) of the k nearest other rows of each row for which is_query (a condition on id) holds."""
    spark = rows.sparkSession
    kind = "<f4" if rows.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    width = np.dtype(kind).itemsize
    packed = staged(_packed(rows, id_col, vector_col, kind).dropDuplicates(["id", "vector"]))
    by_class = Window.partitionBy("vector").orderBy("id")
    index = staged(packed.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1).drop("place"))
    queries = staged(packed.where(is_query("id")))
    leaders = staged(queries.groupBy("vector").agg(F.min("id").alias("leader")))
    lengths = index.groupBy(F.octet_length("vector").alias("size")).count().collect()  # one row for each length
    hashes_of = {r["size"]: hashes_for(r["count"], r["size"] // width) for r in lengths}
    count = probe_count or probe_count_for(index, kind, k, tables, hashes_of)
    n_rows, n_asked = sum(r["count"] for r in lengths), leaders.count()
    units = units_for(spark, (n_rows + n_asked * count) * tables, UNIT_KEYS)

    def all_keys(batch):
        for at, blobs in _by_length(batch.column(0)):
            yield {"key": buckets(_matrix(blobs, kind), tables, hashes_of[len(blobs[0])]).ravel()}

    full_buckets = heavy_keys(map_batches(index.select("vector"), all_keys, "key bigint"), ["key"], HOT_ROWS).orderBy("key").collect()  # HEAVY_KEYS rows at most
    hot = np.array([r["key"] for r in full_buckets], np.int64), np.array([-(-r["rows"] // HOT_ROWS) for r in full_buckets], np.int64)

    def index_keys(batch):
        ids = batch.column(0).to_numpy()
        for at, blobs in _by_length(batch.column(1)):
            keys = buckets(_matrix(blobs, kind), tables, hashes_of[len(blobs[0])])
            yield from _dealt(*_split(keys, hot, ids[at]), units, 1, ids[at], blobs)

    def query_keys(batch):
        ids = batch.column(0).to_numpy()
        for at, blobs in _by_length(batch.column(1), 64):
            keys = probes(_matrix(blobs, kind), tables, hashes_of[len(blobs[0])], count).reshape(len(at), -1)
            yield from _dealt(*_split(keys, hot, None), units, 0, ids[at], blobs)

    def rank(unit: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        asked, own = ([r for r in rows if r[1] == side] for side in (0, 1))
        if not asked or not own:
            return
        best = Best(k + 1)
        key = np.frombuffer(b"".join(r[3] for r in asked), np.uint64)
        query_of = np.repeat(np.arange(len(asked)), [len(r[3]) // 8 for r in asked])
        order = np.argsort(key, kind="stable")
        key, query_of, query_id = key[order], query_of[order], np.array([r[2] for r in asked], np.int64)
        row_id, row = np.array([r[2] for r in own], np.int64), np.repeat(np.arange(len(own)), [len(r[3]) // 8 for r in own])
        own_key = np.frombuffer(b"".join(r[3] for r in own), np.uint64)
        query_size, row_size = (np.array([len(r[4]) for r in side]) for side in (asked, own))
        low = np.searchsorted(key, own_key, "left")
        met = np.searchsorted(key, own_key, "right") - low
        ends, at = np.cumsum(met), 0
        while at < len(own_key):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            c = met[at:until]
            r = np.repeat(row[at:until], c)
            q = query_of[np.repeat(low[at:until], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            at = until
            pair = np.unique(r * len(query_id) + q)
            r, q = pair // len(query_id), pair % len(query_id)
            for size in np.unique(row_size[r]):
                same = (row_size[r] == size) & (query_size[q] == size)
                rr, qq = r[same], q[same]
                if len(rr):
                    (ru, rb), (qu, qb) = np.unique(rr, return_inverse=True), np.unique(qq, return_inverse=True)
                    d = _matrix([own[i][4] for i in ru], kind)[rb] - _matrix([asked[i][4] for i in qu], kind)[qb]
                    best.add(query_id[qq], row_id[rr], np.sqrt((d * d).sum(1)))
        q, r, d = best.best()
        for first in range(0, len(q), 1 << 16):
            part = slice(first, first + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(q[part], pa.int64()), pa.array(r[part], pa.int64()), pa.array(d[part], pa.float64())], ["leader", "vec_id", "score"])

    schema = "unit bigint, kind int, id bigint, keys binary, vector binary"
    both = map_batches(leaders.select(F.col("leader").alias("id"), "vector"), query_keys, schema).unionByName(map_batches(index.select("id", "vector"), index_keys, schema))
    found = by_unit(both, "unit", rank, "leader bigint, vec_id bigint, score double").groupBy("leader", "vec_id").agg(F.min("score").alias("score"))
    near = Window.partitionBy("leader").orderBy("score", "vec_id")
    nearest = lambda rows: rows.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1).drop("place")
    top = staged(nearest(found))
    full = top.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") > k)
    short = staged(leaders.join(full, "leader", "left_anti").select("leader", "vector"))
    if n_short := short.count():
        top = staged(top.join(short, "leader", "left_anti").unionByName(nearest(against_all(short, n_short, index, kind, k))))
    asked = staged(join_split(queries, leaders, ["vector"]).select(F.col("id").alias("query_id"), "leader").distinct())
    # A query is among the k + 1 nearest of its class's leader or has k nearer or equal rows before it.
    answers = join_split(asked, top, ["leader"]).where("query_id != vec_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def against_all(queries: DataFrame, count: int, index: DataFrame, kind: str, k: int) -> DataFrame:
    """leader, vec_id, score: the k + 1 nearest rows of each query (leader, vector) and block of rows; blocks of queries meet blocks of rows."""
    parts = shuffle_partitions(queries.sparkSession)
    blocks = -(-count // QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    asked = queries.select(F.pmod(F.xxhash64("leader"), F.lit(blocks)).alias("q"), every(parts).alias("r"), F.lit(0).alias("kind"), F.col("leader").alias("id"), "vector")
    rows = index.select(every(blocks).alias("q"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("r"), F.lit(1).alias("kind"), "id", "vector")
    dealt = asked.unionByName(rows).repartition(parts, "q", "r").sortWithinPartitions("q", "r", "kind")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place, ids, vectors = Best(k + 1), None, [], []
        for batch in batches:
            q, r, of_row, own = (batch.column(c).to_numpy() for c in range(4))
            cuts = [0, *(np.flatnonzero((q[1:] != q[:-1]) | (r[1:] != r[:-1])) + 1).tolist(), len(batch)] if len(batch) else []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if place != (q[start], r[start]):
                    place, ids, vectors = (q[start], r[start]), [], []
                first = start + int((of_row[start:end] == 0).sum())  # queries come first
                ids += own[start:first].tolist()
                vectors += batch.column(4).slice(start, first - start).to_pylist()
                for at, blobs in _by_length(batch.column(4).slice(first, end - first)):
                    row_id, matrix = own[first + at], _matrix(blobs, kind)
                    for query, vector in zip(ids, vectors, strict=True):
                        if len(vector) == len(blobs[0]):
                            d = matrix - np.frombuffer(vector, kind).astype(np.float64)
                            d = np.sqrt((d * d).sum(1))
                            keep = np.lexsort((row_id, d))[: k + 1]
                            best.add(np.full(len(keep), query), row_id[keep], d[keep])
        a, b, d = best.best()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], ["leader", "vec_id", "score"])

    return dealt.mapInArrow(rank, "leader bigint, vec_id bigint, score double").groupBy("leader", "vec_id").agg(F.min("score").alias("score"))


def _by_length(column: pa.Array, most: int = 512) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(rows, packed vectors) for the vectors of each length, so many at a time."""
    blobs = column.to_pylist()
    size = np.array([len(b) for b in blobs], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for k in range(0, len(at), most):
            yield at[k : k + most], [blobs[i] for i in at[k : k + most]]
