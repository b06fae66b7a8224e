"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

The automaton of all items is built on the driver and broadcast. Documents are streamed through it word by
word; at each word it holds the longest suffix of the text read so far that occurs in an item. A window (ten
words of an item, or a whole shorter item) ends at a word exactly when that longest match covers it. Runs of
words that no item has cannot match, so only runs of benchmark words as long as the shortest window are walked.

The automaton is bounded: items are cut into blocks of at most ``BLOCK_WORDS`` words (one item at least), and
documents pass each block's automaton in turn, so a benchmark of any size works and each broadcast stays small.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; repeated
items count by their distinct ids; a null item id is written as an empty string; repeated documents are judged
each; empty tables give no hits; other columns pass through ``remove`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

#: Words of an item that make a window.
WINDOW = 10
#: Words of a block of items: bounds an automaton at about 2 * BLOCK_WORDS states.
BLOCK_WORDS = 400_000


class Automaton:
    """Generalised suffix automaton over word ids. ``ids`` are the item ids; ``texts`` their texts."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        self.window, self.ids = window, ids
        words, at = K.split(K.strings(pa.array(texts, pa.string())), K.ALNUM)
        distinct, codes = K.coded(words)
        self.words = distinct.cast(pa.large_string()).to_pylist()
        items = [codes[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)]
        self.shortest = min((min(len(i), window) for i in items if i), default=0)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for item in items:
            last = 0
            for w in item:
                last = self._extend(last, w)
        self._windows(items)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def _windows(self, items: list[list[int]]) -> None:
        """For each state: windows that are suffixes of its strings, as (length, items), longest first."""
        ends: dict[tuple[int, int], set[int]] = {}
        for k, item in enumerate(items):
            size = min(len(item), self.window)
            for end, s, m in self.walk(item):
                if size and m >= size:
                    while self.len[self.link[s]] >= size:
                        s = self.link[s]
                    ends.setdefault((s, size), set()).add(k)
        self.short = sorted({size for _, size in ends})
        self.ends = {key: tuple(sorted(v)) for key, v in ends.items()}

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.len
        s = m = 0
        for i, w in enumerate(codes):
            while s and w not in nxt[s]:
                s = link[s]
                m = length[s]
            if w in nxt[s]:
                s = nxt[s][w]
                m += 1
            yield i, s, m

    def hits(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """(begin, end) of all window occurrences in a run of words, and the items they come from."""
        spans, found = [], set()
        ends, link, length = self.ends, self.link, self.len
        for i, s, m in self.walk(codes):
            if m < self.shortest:
                continue
            for size in self.short:
                if m < size:
                    break
                t = s
                while length[link[t]] >= size:
                    t = link[t]
                if (t, size) in ends:
                    spans.append((i + 1 - size, i + 1))
                    found.update(ends[t, size])
        return spans, found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[str], list[str]]]:
    """The items in blocks of bounded size, each collected alone."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = items.where("text IS NOT NULL").groupBy("id", "text").count().drop("count")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (4 * BLOCK_WORDS)))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        if rows:
            yield [r["id"] for r in rows], [r["text"] for r in rows]


def _matched(shared, carried: list[str], margin: int | None):
    """Adds to each row the spans of words that are hit (merged, as a flat array of begins and ends) and the items found;
    with a ``margin``, the text is given without the spans."""

    def run(batches):
        auto: Automaton = shared.value
        known = pa.array(auto.words, pa.large_string())
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                words, at = K.split(K.strings(piece.column("text")), K.ALNUM)
                distinct, codes = K.coded(words)
                n = np.diff(at)
                spans = [list(s or ()) for s in piece.column("spans").to_pylist()]
                found = [set(s or ()) for s in piece.column("items").to_pylist()]
                if len(codes) and auto.shortest:
                    ids = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False)[codes]
                    doc = np.repeat(np.arange(len(n)), n)
                    run_id = np.cumsum(np.concatenate([[True], (ids[1:] < 0) | (ids[:-1] < 0) | (doc[1:] != doc[:-1])])) - 1
                    first = np.flatnonzero(np.concatenate([[True], run_id[1:] != run_id[:-1]]))
                    end = np.concatenate([first[1:], [len(ids)]])
                    for a, z in zip(*(x[(ids[first] >= 0) & (end - first >= auto.shortest)].tolist() for x in (first, end)), strict=True):
                        hit, items = auto.hits(ids[a:z].tolist())
                        if hit:
                            d = int(doc[a])
                            off = a - int(at[d])
                            spans[d] += [x + off for s in hit for x in s]
                            found[d].update(auto.ids[k] for k in items)
                spans = [_merged(s) if s else s for s in spans]
                text = piece.column("text")
                if margin is not None and any(spans):
                    text = pa.array([_without(t, s, margin) for t, s in zip(text.to_pylist(), spans, strict=True)], text.type)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in carried), text, pa.array(n, pa.int64()), pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                    [*carried, "text", "n_words", "n_hit", "spans", "items"],
                )

    return run


def _merged(flat: list[int]) -> list[int]:
    pairs = sorted(zip(flat[::2], flat[1::2], strict=True))
    out = list(pairs[0])
    for a, z in pairs[1:]:
        if a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def _marked(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, carried: tuple[str, ...], window: int, margin: int | None) -> DataFrame:
    """The columns of ``matches``, the carried ones as c0, c1, ...; with a ``margin``, the text without its spans."""
    spark = docs.sparkSession
    scratch, written = Scratch(spark), None
    inner = [f"c{i}" for i in range(len(carried))]
    df = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(carried, inner, strict=True)), F.col(f"`{text_col}`").cast("string").alias("text"))
    types = dict(df.dtypes)
    schema = ", ".join(f"{x} {types[x]}" for x in inner) + ", text string, n_words long, n_hit long, spans array<long>, items array<string>"
    df = df.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
    blocks = _blocks(benchmark, item_col, item_text_col)
    block = next(blocks, ([], []))
    while block:
        after = next(blocks, None)
        df = df.mapInArrow(_matched(spark.sparkContext.broadcast(Automaton(*block, window)), inner, None if after else margin), schema)
        if after:
            df, before = scratch.table(df, "block"), written
            if before is not None:
                scratch.drop(before)
            written = df
        block = after
    return df


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carried: tuple[str, ...] | None = None, window: int = WINDOW) -> DataFrame:
    """Per document: ``carried`` columns (default: the id), ``text``, ``n_words``, ``n_hit``, ``spans`` (begins and ends
    of hit words, flat, merged) and ``items`` (ids of items with occurring windows, sorted as strings). No shuffle."""
    names = carried or (id_col,)
    df = _marked(docs, benchmark, text_col, item_col, item_text_col, names, window, None)
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *(F.col(c) for c in ("text", "n_words", "n_hit", "spans", "items")))


def _without(text: str | None, spans: list[int], margin: int) -> str | None:
    """The text without the words in ``spans`` (and ``margin`` more on each side)."""
    if not spans:
        return text
    data = text.encode()
    mask = np.frombuffer(data.translate(K.ALNUM), np.uint8) != 0x20
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out, at = [], 0
    for a, z in zip(spans[::2], spans[1::2], strict=True):
        a, z = max(a - margin, 0), min(z + margin, len(begin))
        if end[z - 1] > at:
            out.append(data[at : max(begin[a], at)])
            at = end[z - 1]
    out.append(data[at:])
    return b"".join(out).decode()


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, margin: int = 0, most_coverage: float = 0.5) -> DataFrame:
    """Documents with all hit spans cut out of their text, without those of which more than ``most_coverage`` of the words are hit.

    All columns of ``docs`` stay; an ``n_chars`` column is set to the new text's length where the text changed.
    """
    names, types = docs.columns, [t for _, t in docs.dtypes]
    plain = docs.toDF(*(f"k{i}" for i in range(len(names))))
    at = names.index(text_col)
    others = tuple(c for i, c in enumerate(plain.columns) if i != at)
    out = _marked(plain, benchmark, f"k{at}", item_col, item_text_col, others, window, margin)
    out = out.where(F.col("n_hit") <= F.col("n_words") * most_coverage)
    columns = [F.col(f"c{i}") for i in range(len(others))]
    columns.insert(at, F.col("text").cast(types[at]))
    if "n_chars" in names and text_col != "n_chars":
        k = names.index("n_chars")
        columns[k] = F.when(F.size("spans") > 0, F.length("text").cast(types[k])).otherwise(columns[k])
    return out.select(*(c.alias(name) for c, name in zip(columns, names, strict=True)))
