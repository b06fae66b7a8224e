"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits are cut into m segments, and every shard of the index has a table from segment value to codes for
each segment. For a query the search radius of the segments grows in turn; all codes in the probed buckets have
their whole distance verified. After radius r in segments 0..s and r - 1 in the others every code within distance
m r + s has been met (were it in none, it would differ by more), so the search ends once the k-th verified distance
is within that bound. The result is exact, ties by id included.

Equal codes are one entry that keeps its k smallest ids (more can never be among the k nearest by distance, then
id), combined before the shuffle, so a vector with very many copies is no hot bucket. Queries go to all shards in
blocks of at most ``BLOCK`` codes; each shard returns its k best, and those are merged by query.

Defined cases: a null vector has no code: it is not found, and as a query it finds nothing; vectors shorter than
``bits`` count as padded with zeros, longer ones are cut; repeated rows are found each as often as they occur, up
to k; fewer than k rows give fewer results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK, SALTS = 8192, 16


def packed(vectors: pa.Array, bits: int) -> np.ndarray:
    """Sign bits (component > 0) of each vector, as rows of 64-bit words."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0) > 0
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(flat)) - first[row]
    words = -(-bits // 64)
    plane = np.zeros((len(size), words * 64), np.uint8)
    keep = col < bits
    plane[row[keep], col[keep]] = flat[keep]
    return np.packbits(plane, axis=1, bitorder="little").view(np.uint64).reshape(len(size), words)


@cache
def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


class Index:
    """Multi-index hash tables of one shard. ``ids[i]``: the ids of code i, sorted."""

    def __init__(self, codes: np.ndarray, ids: list[list[int]], bits: int):
        self.codes, self.ids, self.bits = codes, ids, bits
        self.count = np.array([len(i) for i in ids], np.int64)
        m = max(1, min(bits, round(bits / max(4, min(16, np.log2(len(codes) + 1))))))
        edge = [bits * i // m for i in range(m + 1)]
        self.segments = list(zip(edge[:-1], edge[1:], strict=True))
        plane = np.unpackbits(codes.view(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")
        self.tables = []
        for a, z in self.segments:
            value = plane[:, a:z].astype(np.int64) @ (1 << np.arange(z - a))
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << (z - a)) + 1))))

    def search(self, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k smallest (distance, id)."""
        plane = np.unpackbits(query.view(np.uint8), bitorder="little")
        own = [int(plane[a:z].astype(np.int64) @ (1 << np.arange(z - a))) for a, z in self.segments]
        seen = np.zeros(len(self.codes), bool)
        at, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = len(self.segments)
        for r in range(max(z - a for a, z in self.segments) + 1):
            for s, (a, z) in enumerate(self.segments):
                if r <= z - a:
                    order, start = self.tables[s]
                    probe = own[s] ^ masks(z - a, r)
                    lo, n = start[probe], start[probe + 1] - start[probe]
                    lo, n = lo[n > 0], n[n > 0]
                    if len(n):
                        got = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                        got = got[~seen[got]]
                        if len(got):
                            seen[got] = True
                            at = np.concatenate([at, got])
                            distance = np.concatenate([distance, np.bitwise_count(self.codes[got] ^ query).sum(axis=1).astype(np.int64)])
                if len(at):
                    inside = distance <= m * r + s
                    if self.count[at[inside]].sum() >= k or len(at) == len(self.codes):
                        return self._best(at, distance, k)
        return self._best(at, distance, k)

    def _best(self, at: np.ndarray, distance: np.ndarray, k: int) -> list[tuple[int, int]]:
        order = np.argsort(distance, kind="stable")
        enough = np.searchsorted(np.cumsum(self.count[at[order]]), k)
        if enough < len(order):
            order = order[: np.searchsorted(distance[order], distance[order[enough]], side="right")]
        return sorted((int(distance[o]), i) for o in order for i in self.ids[at[o]])[:k]


def _coded(bits: int, k: int):
    """(code, salt, ids): equal codes of a slice as one row with their k smallest ids."""

    def run(batches):
        for batch in batches:
            codes = packed(batch.column("vector"), bits)
            ids = batch.column("id").to_pylist()
            held: dict[bytes, list[int]] = {}
            for code, i in zip((c.tobytes() for c in codes), ids, strict=True):
                held.setdefault(code, []).append(i)
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([salt] * len(held), pa.int32()), pa.array([sorted(v)[:k] for v in held.values()], pa.list_(pa.int64()))], ["code", "salt", "ids"])

    return run


def _searched(shared, bits: int, k: int):
    def run(batches):
        codes, ids = [], []
        for batch in batches:
            codes += batch.column("code").to_pylist()
            ids += batch.column("ids").to_pylist()
        if codes:
            index = Index(np.frombuffer(b"".join(codes), np.uint64).reshape(len(codes), -1), ids, bits)
            for raw in shared.value:
                best = index.search(np.frombuffer(raw, np.uint64), k)
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([[{"distance": d, "id": i} for d, i in best]], pa.list_(pa.struct([("distance", pa.int32()), ("id", pa.int64())])))], ["code", "best"])

    return run


def _smallest(lists: str, k: int):
    return F.slice(F.array_sort(F.flatten(F.collect_list(lists))), 1, k)


def search(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", bits: int | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``distance`` of each query's k nearest rows of ``base``."""
    spark, scratch = base.sparkSession, Scratch(base.sparkSession)
    take = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    rows, asked = take(base), take(queries)
    if bits is None:
        bits = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    coded = rows.mapInArrow(_coded(bits, k), "code binary, salt int, ids array<long>")
    coded = coded.groupBy("code", "salt").agg(_smallest("ids", k).alias("ids")).groupBy("code").agg(_smallest("ids", k).alias("ids"))
    index = scratch.table(coded, "index")
    wanted = asked.mapInArrow(_coded(bits, 1 << 30), "code binary, salt int, ids array<long>").select("code", F.explode("ids").alias("query_id"))
    wanted = scratch.table(wanted, "queries")
    codes = scratch.table(wanted.select("code").distinct(), "codes")
    blocks = max(1, -(-codes.count() // BLOCK))
    best = None
    for b in range(blocks):
        block = sorted(bytes(r["code"]) for r in codes.where(F.pmod(F.xxhash64("code"), F.lit(blocks)) == b).toLocalIterator())
        shared = spark.sparkContext.broadcast(block)  # about BLOCK codes
        found = index.mapInArrow(_searched(shared, bits, k), "code binary, best array<struct<distance:int,id:bigint>>")
        found = scratch.table(found.groupBy("code").agg(_smallest("best", k).alias("best")), "best")
        best = found if best is None else best.union(found)
    out = wanted.join(best, "code").select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias(id_col), F.col("b.distance").alias("distance"))


#: DuckDB SQL of the ten nearest rows, by sign bits, of every vector whose id is divisible by 50.
SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x, 0) > 0) AS c FROM embeddings),
d AS (SELECT q.vec_id AS query_id, e.vec_id, len(list_filter(list_zip(q.c, e.c), lambda p: p[1] <> p[2]))::INTEGER AS distance
      FROM (SELECT * FROM e WHERE vec_id % 50 = 0) q, e)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance
FROM d QUALIFY rank <= 10
"""
