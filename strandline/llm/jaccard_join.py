"""Exact Jaccard self-join of word-shingle sets: size-banded tiles with hashed bitmap signatures.

1. Each text becomes a sorted array of 64-bit shingle hashes; equal sets are one node (a content hash).
2. Set sizes are cut into geometric bands. Two sets that link differ in at most D shingles, D growing with
   the band's upper size. The hash range is cut into more than D parts, so at least one part of two linking
   sets is equal: a signature per (band, part) brings all linking sets together in some group, and a passage
   that many texts share brings nobody together. A set near a band's end also joins the next band's groups.
3. Every group pairs its smallest node with each other one (a star, linear in the group). A bitmap of about
   four bits a shingle bounds each overlap from above; of what passes, each node's likeliest pair is settled by
   exact array intersection.
4. Groups that still hold two components (those with the same smallest node count as one group, called a family) are
   cut into tiles by size; bitmaps of a family's tile pairs are compared across components, and nodes that pass are
   tiled again with their arrays, settling every pair that matters in the tile. Then every linking pair
   has been settled or lies within one component, so components are exact.

Defined cases: a null, empty or blank text has the empty set and links with nothing; a text with fewer words
than a shingle is one shingle; repeated rows and ties get the same component; a null id takes the smallest id
of its component, else stays null; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from .scratch import Scratch

#: Ratio of a band's upper to its lower size.
BAND = 1.5
#: Signatures that a task gathers before it hands them on.
FLUSH = 600_000
#: From so many equal signatures in one task on, one of them travels and the others are passed by.
HOT = 64
#: Weight of a tile: a node counts one, or more if it has over ``HEAVY`` shingles; so a tile's arrays stay under 17 MB or hold one node.
TILE, HEAVY = 512, 4096
#: Up to so many candidate ids are broadcast (16 bytes each); more are joined by shuffle.
MOST_BROADCAST = 1_000_000


class Banding:
    """Bands of set sizes and their numbers of parts, for links with ``den * overlap >= num * union``."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        if not 0 < num <= den:
            raise ValueError("need 0 < num <= den")
        self.num, self.den = num, den
        low = [1]
        while low[-1] < most:
            low.append(max(low[-1] + 1, math.ceil(low[-1] * BAND)))
        self.low = np.array(low, np.int64)
        differ = (2 * (self.low[1:] - 1)) * (den - num) // (den + num)
        load = num / den * self.low[:-1] / (differ + 1)
        empty = (differ + 1) * np.exp(-load)
        #: Parts that may be empty before a set also signs its empty parts.
        self.slack = np.where(differ > 0, np.ceil(1.3 * empty + np.sqrt(empty)), 0).astype(np.int64)
        self.parts = np.where(differ > 0, differ + 1 + self.slack, 0)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1

    def least_overlap(self, total):
        """Smallest overlap with which two sets of ``total`` elements together link."""
        return -((-self.num * total) // (self.num + self.den))


def signatures(values: np.ndarray, at: np.ndarray, b: Banding) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the set that each belongs to. Sets in bands without a permitted difference have none."""
    sizes = np.diff(at)
    out_s, out_d = [], []
    own = b.band(np.maximum(sizes, 1))
    for step in range(len(b.parts)):
        band = np.minimum(own + step, len(b.parts) - 1)
        reach = (sizes > 0) & (own + step < len(b.parts)) & ((step == 0) | (b.den * sizes >= b.num * b.low[band]))
        if not reach.any():
            break
        rows = np.flatnonzero(reach & (b.parts[band] > 0))
        if not len(rows):
            continue
        n, m, g = sizes[rows], b.parts[band[rows]], band[rows]
        base = np.concatenate([[0], np.cumsum(m)])
        doc = np.repeat(np.arange(len(rows)), n)
        first = np.concatenate([[0], np.cumsum(n)])
        v = values[np.arange(first[-1]) - first[doc] + at[rows][doc]]
        part = ((v >> np.uint64(32)) * m[doc].astype(np.uint64)) >> np.uint64(32)
        slot = base[doc] + part.astype(np.int64)  # in order, since the values of a set are sorted
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        total = np.zeros(base[-1], np.uint64)
        total[slot[begin]] = np.add.reduceat(K.mix(v), begin)
        full = np.zeros(base[-1], bool)
        full[slot[begin]] = True
        owner = np.repeat(np.arange(len(rows)), m)
        which = (np.arange(base[-1]) - base[owner] + (g[owner] << 32)).astype(np.uint64)
        empties = m - np.bincount(owner[full], minlength=len(rows))
        take = full | (empties > b.slack[g])[owner]
        out_s.append(K.mix(total[take] ^ K.mix(which[take] + np.uint64(0x9E3779B97F4A7C15))))
        out_d.append(rows[owner[take]])
    if not out_s:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_d)


def bitmap(values: np.ndarray) -> bytes:
    """About four bits a value; the length is a power of two, so a longer one folds onto a shorter one."""
    bits = max(64, 1 << (4 * max(len(values), 1) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[((values >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(bits, np.uint64)
    while len(a) * 8 > size:
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    return a


def most_overlap(x: bytes, y: bytes, total: int) -> int:
    """Upper bound of the overlap of two sets with ``total`` elements together, from their bitmaps."""
    size = min(len(x), len(y))
    return (total - int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())) // 2


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted arrays of distinct values share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _sets(batches: Iterator[pa.RecordBatch], n: int, seed: int, column: str = "text"):
    """(slice, shingles, where each set begins, node of each set) in slices of a few MB."""
    for batch in batches:
        for piece in K.pieces(batch, column):
            values, at = K.shingle_sets(K.strings(piece.column(column)), n)
            raw = values.tobytes()
            nodes = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * a : 8 * z], seed) for a, z in zip(at[:-1], at[1:], strict=True)), np.uint64, len(at) - 1).view(np.int64)
            yield piece, values, at, nodes


def _profile(n: int, seed: int, carried: list[str]):
    def run(batches):
        for piece, values, at, nodes in _sets(batches, n, seed):
            raw, sizes = values.tobytes(), np.diff(at)
            check = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * z], seed + 1) >> 1 for a, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carried), pa.array(sizes), pa.array(nodes, mask=sizes == 0), pa.array(check, pa.int64())], [*carried, "n_shingles", "node", "check"])

    return run


def _signed(n: int, seed: int, banding: Banding, buckets: int):
    """Packs signatures and nodes by bucket. Of a signature that is hot in this task one travels, marked; the others pass by."""

    def packed(s: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
        s, d = s[new], d[new]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.concatenate([first, [len(s)]]))
        at = np.arange(len(s)) - np.repeat(first, count)
        hot = np.repeat(count >= HOT, count)
        kind = np.where(hot, np.where(at == 0, 1, 2), 0)  # 0: plain, 1: stands for a hot one, 2: passes by
        bucket = np.where(kind == 2, K.mix(s ^ K.mix(d.view(np.uint64))), s) % np.uint64(buckets)
        lane = bucket.astype(np.int64) * 3 + kind
        order = np.lexsort((d, lane))
        lane, s, d = lane[order], s[order], d[order]
        cut = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        end = np.concatenate([cut[1:], [len(lane)]])
        return pa.RecordBatch.from_arrays(
            [pa.array((lane[cut] // 3).astype(np.int32)), pa.array((lane[cut] % 3).astype(np.int32)), pa.array([s[a:z].tobytes() for a, z in zip(cut, end, strict=True)], pa.binary()), pa.array([d[a:z].tobytes() for a, z in zip(cut, end, strict=True)], pa.binary())],
            ["bucket", "kind", "signs", "nodes"],
        )

    def run(batches):
        held, most = [], 0
        for _, values, at, nodes in _sets(batches, n, seed):
            s, d = signatures(values, at, banding)
            held.append((s, nodes[d]))
            most += len(s)
            if most >= FLUSH:
                yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, most = [], 0
        if most:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _met(batches):
    """(sign, node) of all signatures that more than one node has."""
    signs, nodes, marks = [], [], []
    for batch in batches:
        for kind, s, d in zip(*(batch.column(c).to_pylist() for c in ("kind", "signs", "nodes")), strict=True):
            s, d = np.frombuffer(s, np.int64), np.frombuffer(d, np.int64)
            if kind == 2:
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], ["sign", "node"])
            else:
                signs.append(s), nodes.append(d), marks.append(np.full(len(s), kind == 1))
    if signs:
        s, d, mark = np.concatenate(signs), np.concatenate(nodes), np.concatenate(marks)
        order = np.lexsort((d, s))
        s, d, mark = s[order], d[order], mark[order]
        group = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) - 1
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        several = (np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first)) | np.logical_or.reduceat(mark, first)
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) & several[group]
        yield pa.RecordBatch.from_arrays([pa.array(s[new]), pa.array(d[new])], ["sign", "node"])


def _arrays(n: int, seed: int, whole: bool):
    """Bitmap of each wanted node, once a task, and its shingles too if ``whole``."""

    def run(batches):
        seen: set[int] = set()
        for piece, values, at, nodes in _sets(batches, n, seed):
            wanted = piece.column("node").to_pylist()
            rows = []
            for i, (node, want) in enumerate(zip(nodes.tolist(), wanted, strict=True)):
                if node == want and node not in seen:
                    seen.add(node)
                    rows.append(i)
            if rows:
                sets = [values[at[i] : at[i + 1]] for i in rows]
                more = [pa.array([s.tobytes() for s in sets], pa.binary())] if whole else []
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), *more], ["node", "n", "bits", "shingles"][: 3 + whole])

    return run


def _bounded(banding: Banding):
    """Pairs whose bitmaps allow a link, with the bound of their similarity."""

    def run(batches):
        for batch in (piece for whole in batches for piece in K.pieces(whole, "bits_a")):
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "bits_a", "bits_b")), strict=True)
            kept = []
            for a, b, n_a, n_b, bits_a, bits_b in rows:
                most = most_overlap(bits_a, bits_b, n_a + n_b)
                if most >= banding.least_overlap(n_a + n_b):
                    kept.append((a, b, most / max(n_a + n_b - most, 1)))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "like"])

    return run


def _settled(banding: Banding):
    def run(batches):
        for batch in (piece for whole in batches for piece in K.pieces(whole, "x")):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = overlap(x, y)
                keep.append(banding.den * common >= banding.num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def tile_candidates(rows: list[tuple], banding: Banding):
    """(i, places j) for each row of a tile pair that may link with rows of other components, by bitmaps.

    rows: (node, root, n, bits, ..., side), side 0 for the left tile, 1 for the right one, 2 for both at once.
    """
    size = min(len(r[3]) for r in rows)
    bits = np.stack([folded(r[3], size) for r in rows])
    n, side = np.array([r[2] for r in rows]), np.array([r[-1] for r in rows])
    number = {root: i for i, root in enumerate(dict.fromkeys(r[1] for r in rows))}
    label = np.array([number[r[1]] for r in rows])
    for i in np.flatnonzero(side != 1):
        j = np.flatnonzero((label != label[i]) & ((side == 1) if side[i] == 0 else (np.arange(len(rows)) > i)))
        if len(j):
            total = n[i] + n[j]
            most = (total - np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)) // 2
            j = j[(most >= banding.least_overlap(total)) & (np.minimum(n[i], n[j]) * banding.den >= np.maximum(n[i], n[j]) * banding.num)]
            if len(j):
                yield int(i), j, label


def tile_links(rows: list[tuple], banding: Banding) -> list[tuple[int, int]]:
    """Links between different components, enough of them to join all that the tile pair can join. rows[4]: shingles."""
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    out = []
    for i, places, label in tile_candidates(rows, banding):
        for k in places.tolist():
            if label[k] != label[i] and overlap(sets[i], sets[k]) >= banding.least_overlap(rows[i][2] + rows[k][2]):
                out.append((min(rows[i][0], rows[k][0]), max(rows[i][0], rows[k][0])))
                label[label == label[k]] = label[i]
    return out


def _tiled(banding: Banding, whole: bool):
    """Runs over rows sorted by tile pair. With shingles: links (a, b); with bitmaps only: rows (a, a) for nodes that may link."""
    names = ["family", "p", "q", "node", "root", "n", "bits", *(["shingles"] if whole else []), "side"]

    def run(batches):
        key, rows = None, []

        def close():
            links = []
            if len({r[1] for r in rows}) > 1:
                if whole:
                    links = tile_links(rows, banding)
                else:
                    near = {x for i, places, _ in tile_candidates(rows, banding) for x in (i, *places.tolist())}
                    links = [(rows[i][0], rows[i][0]) for i in sorted(near)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in (piece for large in batches for piece in K.pieces(large, "shingles" if whole else "bits")):
            for family, left, right, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (family, left, right) != key:
                    if rows:
                        yield close()
                    key, rows = (family, left, right), []
                rows.append(tuple(row))
        if rows:
            yield close()

    return run


def _placed(sized: DataFrame, tile: int, scratch: Scratch) -> DataFrame:
    """``tile`` from 0 of each row in its family by (own, n, node), from the weight before it. Rows are cut into ranges, so a
    large family is placed by many tasks: before a row lie the rows of its range and the family's earlier ranges."""
    order = [F.col("own").asc_nulls_last(), F.col("n"), F.col("node")]
    weight = F.greatest(F.lit(1.0), F.col("n") / HEAVY).alias("weight")
    ranged = scratch.table(sized.select("*", weight).repartitionByRange(F.col("family"), *order).withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("family", "part").agg(F.sum("weight").alias("all"))
    before = sums.select("family", "part", (F.sum("all").over(W.partitionBy("family").orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("weight").over(W.partitionBy("family", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("weight")
    return ranged.withColumn("inside", inside).join(before, ["family", "part"]).withColumn("tile", F.floor((F.col("inside") + F.col("before")) / tile))


def _across(open_nodes: DataFrame, sets: DataFrame, banding: Banding, scratch: Scratch) -> DataFrame:
    """Links between components within each family of ``open_nodes (family, node, root)``, or with bitmaps only in ``sets``
    the nodes that may have some.

    A family's nodes are put in order, large components first and each by size, and cut into tiles. Tile pairs whose
    sizes cannot link, or that hold the same one component, are left out; so a large component meets the rest only.
    """
    whole = "shingles" in sets.columns
    tile = TILE if whole else 4 * TILE  # bitmaps are small
    sized = open_nodes.join(sets.select("node", "n"), "node")
    mass = sized.groupBy("family", "root").agg(F.count("*").alias("mass"))
    sized = sized.join(mass, ["family", "root"]).withColumn("own", F.when(F.col("mass") >= tile, F.col("root")))
    placed = _placed(sized, tile, scratch).select("family", "tile", "node", "root", "n")
    tiles = placed.groupBy("family", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("first"), F.max("root").alias("last"))
    left = tiles.select("family", *(F.col(c).alias(f"l_{c}") for c in tiles.columns[1:]))
    right = tiles.select("family", *(F.col(c).alias(f"r_{c}") for c in tiles.columns[1:]))
    fit = (F.col("l_tile") <= F.col("r_tile")) & (F.col("r_hi") * banding.den >= F.col("l_lo") * banding.num) & (F.col("l_hi") * banding.den >= F.col("r_lo") * banding.num)
    one = (F.col("l_first") == F.col("l_last")) & (F.col("r_first") == F.col("r_last")) & (F.col("l_first") == F.col("r_first"))
    pairs = left.join(right, "family").where(fit & ~one).select("family", F.col("l_tile").alias("p"), F.col("r_tile").alias("q"))
    both = F.array(F.struct(F.col("p").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("q").alias("tile"), F.lit(1).alias("side")))
    sides = pairs.select("family", "p", "q", F.explode(F.when(F.col("p") == F.col("q"), F.array(F.struct(F.col("p").alias("tile"), F.lit(2).alias("side")))).otherwise(both)).alias("s"))
    sides = sides.select("family", "p", "q", F.col("s.tile").alias("tile"), F.col("s.side").alias("side"))
    rows = placed.drop("n").join(sides, ["family", "tile"]).join(sets, "node")
    rows = rows.select("family", "p", "q", "node", "root", "n", "bits", *(["shingles"] if whole else []), "side").repartition("family", "p", "q")
    return rows.sortWithinPartitions("family", "p", "q").mapInArrow(_tiled(banding, whole), "a long, b long")


def _bounded_ids(ids: DataFrame, count: int) -> DataFrame:
    return F.broadcast(ids) if count <= MOST_BROADCAST else ids


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id_col``, ``carried``, ``n_shingles``, ``component_id``, the smallest id reachable by
    links, and ``group``, a number for each component (null for empty sets), where two texts link if ``den * overlap >= num * union`` of their sets of ``n``-word shingles."""
    spark, scratch, banding = docs.sparkSession, Scratch(docs.sparkSession), Banding(num, den)
    kept = list(dict.fromkeys([id_col, *carried]))
    inner = [f"c{i}" for i in range(len(kept))]
    base = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(kept, inner, strict=True)), F.col(f"`{text_col}`").cast("string").alias("text"))
    base = base.withColumn("digest", F.xxhash64("text"))
    inner.append("digest")
    types = dict(base.dtypes)
    head = ", ".join(f"{x} {types[x]}" for x in inner)
    for seed in range(0, 40, 2):
        profile = scratch.table(base.mapInArrow(_profile(n, seed, inner), f"{head}, n_shingles long, node long, check long"), "profile", compact=True)
        # one row stands for a node; null ids and repeated ones are told apart by their texts
        first = F.min(F.struct(F.col("c0").isNull().alias("last"), "c0", "digest")).alias("row")
        classes = profile.where("node IS NOT NULL").groupBy("node").agg(first, F.min("check").alias("lo"), F.max("check").alias("hi"))
        classes = classes.select("node", F.col("row.c0").alias("least"), F.col("row.digest").alias("digest"), "lo", "hi")
        classes = scratch.table(classes, "classes")
        if not classes.where("lo <> hi").limit(1).count():
            break  # no two different sets have the same node
    else:
        raise RuntimeError("different sets got equal 64-bit hashes with every seed")
    volume = profile.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = int(min(20_000, max(32, 2 * volume * (den - num) / (den + num) * 1.7 // 500_000 + 1)))
    met = base.select("text").mapInArrow(_signed(n, seed, banding, buckets), "bucket int, kind int, signs binary, nodes binary")
    met = scratch.table(met.repartition(buckets, "bucket").mapInArrow(_met, "sign long, node long"), "met", compact=True)
    roots = _roots(base, met, classes, scratch, banding, n, seed)
    least = classes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component"))
    of = classes.join(roots, "node", "left").join(least, "root", "left").select("node", F.coalesce("component", "least").alias("component"), F.coalesce("root", "node").alias("group"))
    out = profile.join(of, "node", "left")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "n_shingles", F.coalesce("component", "c0").alias("component_id"), "group")


def _roots(base: DataFrame, met: DataFrame, classes: DataFrame, scratch: Scratch, banding: Banding, n: int, seed: int) -> DataFrame:
    groups = met.groupBy("sign").agg(F.min("node").alias("hub"), F.count("*").alias("size"))
    star = met.join(groups, "sign").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    star = scratch.table(star, "star")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()

    def found(nodes: DataFrame, whole: bool) -> DataFrame:
        """Bitmaps, and shingles if asked for, of the nodes, from the texts of the smallest ids that have them."""
        wanted = scratch.table(nodes.join(classes.select("node", "least", F.col("digest").alias("of")), "node"), "wanted")
        texts = base.select("text", "c0", "digest").join(_bounded_ids(wanted, wanted.count()), F.col("c0").eqNullSafe(F.col("least")) & (F.col("digest") == F.col("of"))).select("text", "node")
        out = scratch.table(texts.mapInArrow(_arrays(n, seed, whole), "node long, n long, bits binary" + ", shingles binary" * whole), "sets", compact=not whole)
        if out.select("node").distinct().count() != out.count():
            out = scratch.table(out.dropDuplicates(["node"]), "sets")
        return out

    bits = found(ends(star), False)
    a = bits.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = bits.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    near = star.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bounded(banding), "a long, b long, like double")
    # a node's likeliest hub first; whatever other hubs would join is found among the open groups
    near = scratch.table(near.groupBy("b").agg(F.max(F.struct("like", F.col("a"))).alias("best")).select(F.col("best.a").alias("a"), "b"), "near")
    arrays = found(ends(near), True)
    x = arrays.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = arrays.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    links = scratch.table(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_settled(banding), "a long, b long"), "links", compact=True)
    scratch.drop(arrays)
    roots = components(links, scratch)
    at = met.join(roots, "node", "left").select("sign", "node", F.coalesce("root", "node").alias("root"))
    open_ = at.groupBy("sign").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("hub")).where("lo <> hi").select("sign", "hub")
    met_open = scratch.table(at.join(open_, "sign").select("node", "root", "hub").distinct(), "open")
    if met_open.limit(1).count():
        # groups are tiled one by one: joined to families they would grow with the corpus, and tile pairs with the square of that
        members = met_open.select(F.col("hub").alias("family"), "node", "root")
        may = found(_across(members, bits, banding, scratch).select(F.col("a").alias("node")).distinct(), True)
        if may.limit(1).count():
            across = scratch.table(_across(members, may, banding, scratch), "across", compact=True)
            roots = components(links.union(across), scratch)
    return roots


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id (null ids last), then text hash, then columns.

    Texts without words stay all. All columns stay. Only the list of rows that go meets the texts, broadcast up to
    ``MOST_BROADCAST`` rows.
    """
    scratch, names = Scratch(docs.sparkSession), docs.columns
    columns = [f"c{i}" for i in range(len(names))]
    id_, text = columns[names.index(id_col)], columns[names.index(text_col)]
    hashed = docs.toDF(*columns).withColumn("h", F.xxhash64(F.col(text).cast("string")))
    marks = linked(hashed, id_, text, n, num, den, carried=("h",)).where(F.col("group").isNotNull())
    marks = marks.select(F.col(id_).alias("id"), "h", "group").groupBy("id", "h").agg(F.min("group").alias("group"), F.count("*").alias("rows"))
    marks = scratch.table(marks, "marks")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("h"))
    best = marks.groupBy("group").agg(F.min(order).alias("best"))
    status = scratch.table(marks.join(best, "group").select("id", F.col("h").alias("g"), "rows", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))).alias("keep")), "status")
    same = F.col(id_).eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))

    def listed(condition) -> DataFrame:
        rows = status.where(condition).select("id", "g")
        return _bounded_ids(rows, rows.count())

    out = hashed.join(listed(~F.col("keep")), same, "left_anti")
    repeated = F.col("keep") & (F.col("rows") > 1)
    if status.where(repeated).limit(1).count():
        many = listed(repeated)
        one = out.join(many, same, "left_semi").groupBy(F.col(id_).alias("id"), "h").agg(F.min(F.struct(*columns)).alias("row"))
        return out.join(many, same, "left_anti").select(*columns).union(one.select("row.*")).toDF(*names)
    return out.select(*columns).toDF(*names)
