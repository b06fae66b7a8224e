"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over sampled labelled texts. A text is parsed from left to right
into the longest phrases that occur in a language's sample; phrases times the logarithm of the sample's length is
its code length under that language, and the shortest code wins. Phrases need transitions only: a language's
``DENSE`` most frequent letters have a column each in a table whose missing entries lead on from the start with a
phrase counted, its other letters are looked up in a sorted list. Texts are parsed side by side, one character each
at a time. Long ones are cut into lanes that are parsed at once; each lane is then parsed again from the state that
the one before ends in, until both states meet, so the phrases are those of the whole text.

Training takes a bounded sample of rows: of each language the different texts with the smallest hashes, whole, until
they have ``ENOUGH_CHARS`` characters together, ``SAMPLE_TEXTS`` texts at most. Every language and every letter counts.

Defined cases: a text that is null or without a letter is ``und`` with score 0; without any training text all are
``und``; ties go to the language that sorts first; a null id is never learned from and not held out; repeated
rows are predicted each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SAMPLE_TEXTS, ENOUGH_CHARS = 64, 40_000
#: Letters of a language with a table column. Its classes: 0 for all that is no letter, 1 for letters that its sample lacks.
DENSE = 62
LANE = 1024
UNKNOWN = "und"
#: Marks one phrase ended in a transition; twice it, two: the phrase so far, and a character that the sample lacks.
_MISS = 1 << 29
#: Bits of a class in the key of a sparse transition.
_LETTER = 21


@functools.cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point where that is one code point, and which are letters."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            letter[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return lower, letter


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def transitions(sample: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix automaton of the class sequences: a table (state, class) -> state for classes up to DENSE + 1, and sorted keys
    (state, class) with their states for the others. A miss is the state after the start, marked with the phrases ended; a
    class that the sample lacks leads back to the start. The table's first rows are the states; state 0 is the start."""
    nxt, link, length = [{}], [-1], [0]

    def clone(p, w, q):
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    for text in sample:
        last = 0
        for w in text.tolist():
            if w in nxt[last]:
                q = nxt[last][w]
                last = q if length[q] == length[last] + 1 else clone(last, w, q)
                continue
            cur, p = len(nxt), last
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else clone(p, w, q)
            last = cur
    width = DENSE + 2
    start = np.full(width, 2 * _MISS, np.int32)
    for w, q in nxt[0].items():
        if w < width:
            start[w] = q | _MISS
    table = np.tile(start, (len(nxt), 1))
    table[0] = np.where(start >= 2 * _MISS, _MISS, start & (_MISS - 1))
    far = []
    for state, row in enumerate(nxt):
        near = [w for w in row if w < width]
        if near:
            table[state, near] = [row[w] for w in near]
        far += [(state << _LETTER | w, q) for w, q in row.items() if w >= width]
    keys, to = np.array(sorted(far), np.int64).reshape(-1, 2).T
    return table, keys, to.astype(np.int32)


class Model:
    """Automata of all languages. ``samples``: language -> texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.samples = {k: samples[k] for k in sorted(samples)}
        self.langs = list(self.samples)
        self._made = None

    def __getstate__(self):
        return {"samples": self.samples, "langs": self.langs, "_made": None}  # each process makes its own tables

    def made(self):
        if self._made is None:
            lower, letter = _folding()
            seen = [[lower[p][letter[p]] for p in map(points, texts)] for texts in self.samples.values()]
            alphabet = np.unique(np.concatenate([x for texts in seen for x in texts] + [np.zeros(0, np.uint32)]))
            # 0: no letter, 1: a letter of no sample, then each letter; of each language's own classes the table holds the most frequent
            lut = np.ones(0x110000, np.int32)
            lut[alphabet] = np.arange(2, len(alphabet) + 2)
            lut = lut[lower]
            lut[~letter] = 0
            own = np.ones((len(self.langs), len(alphabet) + 2), np.int32)
            own[:, 0] = 0
            tables, starts, keys, to, weight, base = [], [], [], [], [], 0
            for i, texts in enumerate(self.samples.values()):
                counts = np.bincount(np.searchsorted(alphabet, np.concatenate([*seen[i], np.zeros(0, np.uint32)])), minlength=len(alphabet))
                order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
                own[i, order + 2] = np.arange(2, len(order) + 2)
                coded = [own[i][_joined(lut[points(t)])] for t in texts]
                table, k, q = transitions(coded)
                tables.append(((table & (_MISS - 1)) + base) | (table & ~(_MISS - 1)))
                keys.append(k + (base << _LETTER))
                to.append(q + base)
                starts.append(base)
                base += len(table)
                weight.append(math.log2(sum(map(len, coded)) + 2))
            empty = np.zeros(0, np.int64)
            self._made = lut, own, np.concatenate([t.ravel() for t in tables] or [np.zeros(0, np.int32)]), np.concatenate([empty, *keys]), np.concatenate([np.zeros(0, np.int32), *to]), np.array(starts, np.int64), np.array(weight)
        return self._made

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """Classes of the characters over all languages, runs of non-letters as one."""
        return _joined(self.made()[0][codes])

    def _step(self, state: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and phrases ended, for the language's own classes."""
        _, _, table, keys, to, starts, _ = self.made()
        far = local >= DENSE + 2
        v = table[state * (DENSE + 2) + np.where(far, 1, local)]
        if far.any():
            at_start = starts[np.searchsorted(starts, state[far], side="right") - 1]
            for source, ended in ((at_start, 1), (state[far], 0)):  # the state's own transition, else the start's
                key = (source << _LETTER) | local[far]
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[k] == key
                v[np.flatnonzero(far)[hit]] = to[k[hit]] | (ended * _MISS)
        return (v & (_MISS - 1)).astype(np.int64), v >> 29

    def phrases(self, coded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each text (their classes one after another, from ``at`` on) under each language."""
        _, own, _, _, _, starts, _ = self.made()
        size, many = np.diff(at), len(starts)
        lanes = -(-size // LANE)
        doc = np.repeat(np.arange(len(size)), lanes)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        out = np.zeros((many, len(size)), np.int64)
        if not len(doc):
            return out
        begin, n = at[doc] + k * LANE, np.minimum(size[doc] - k * LANE, LANE)
        order = np.argsort(-n, kind="stable")
        state = np.repeat(starts[:, None], len(n), axis=1)
        count = np.zeros(state.shape, np.int64)
        live = np.searchsorted(-n[order], -np.arange(n.max()), side="left")  # lanes longer than each step
        for step, w in enumerate(live.tolist()):
            lane = order[:w]
            local = own[:, coded[begin[lane] + step]]
            now, ended = self._step(state[:, :w].ravel(), local.ravel())
            state[:, :w] = now.reshape(many, w)
            count[:, :w] += ended.reshape(many, w)
        back = np.argsort(order)
        state, count = state[:, back], count[:, back]
        for nth in range(1, int(lanes.max())):
            lang, lane = (x.ravel() for x in np.meshgrid(np.arange(many), np.flatnonzero(k == nth), indexing="ij"))
            true, fresh = state[lang, lane - 1], starts[lang]  # from the lane before, and as parsed above
            step = 0
            while True:
                met = true == fresh
                lang, lane, true, fresh = lang[~met], lane[~met], true[~met], fresh[~met]
                done = n[lane] <= step
                state[lang[done], lane[done]] = true[done]  # never met
                lang, lane, true, fresh = lang[~done], lane[~done], true[~done], fresh[~done]
                if not len(lane):
                    break
                local = own[lang, coded[begin[lane] + step]]
                true, more = self._step(true, local)
                fresh, less = self._step(fresh, local)
                np.add.at(count, (lang, lane), more - less)
                step += 1
        ends = np.cumsum(lanes) - 1
        for i in range(many):
            out[i] = np.bincount(doc, count[i], len(size))
            out[i][lanes > 0] += state[i, ends[lanes > 0]] != starts[i]  # the last, unfinished phrase
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        raw = b"" if not len(texts) else K.translated(texts, bytes(range(256))).buffers()[2].to_pybytes()
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.langs:
            return [UNKNOWN] * len(chars), np.zeros(len(chars))
        lut, *_, weight = self.made()
        cls = lut[codes]
        doc = np.repeat(np.arange(len(chars)), chars)
        keep = np.ones(len(cls), bool)
        keep[1:] = (cls[1:] != 0) | (cls[:-1] != 0) | (doc[1:] != doc[:-1])
        letters = np.bincount(doc[cls != 0], minlength=len(chars))
        cls, sizes = cls[keep], np.bincount(doc[keep], minlength=len(chars))
        cost = self.phrases(cls, np.concatenate([[0], np.cumsum(sizes)])) * weight[:, None]
        best = cost.argmin(axis=0)
        ranked = np.sort(cost, axis=0)
        second = ranked[1] if len(self.langs) > 1 else ranked[0] * 2
        score = np.where(letters > 0, second / np.maximum(ranked[0] + second, 1e-9), 0.0)
        return [self.langs[b] if l else UNKNOWN for b, l in zip(best.tolist(), letters.tolist(), strict=True)], score


def _joined(classes: np.ndarray) -> np.ndarray:
    """Runs of non-letters as one."""
    return classes[np.concatenate([[True], (classes[1:] != 0) | (classes[:-1] != 0)])] if len(classes) else classes


def held_out(id_: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from all rows given; pass training rows only."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    texts = rows.groupBy("lang", "h").count().drop("count")
    counts = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return Model({})
    # so many hashes are below the limit that fewer than SAMPLE_TEXTS are out of the question; for few texts all are
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * SAMPLE_TEXTS / n)))), F.col("lang"))
    low = texts.where(F.col("h") < share * (1 << 40)).collect()
    drawn: dict[str, list[int]] = {}
    for r in sorted(low, key=lambda r: (r["lang"], r["h"])):
        drawn.setdefault(r["lang"], []).append(r["h"])
    chosen = docs.sparkSession.createDataFrame([(lang, h) for lang, hs in drawn.items() for h in hs[:SAMPLE_TEXTS]], "lang string, h long")
    got = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()  # SAMPLE_TEXTS a language
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"])):
        own = samples.setdefault(r["lang"], [])
        if sum(map(len, own)) < ENOUGH_CHARS:
            own.append(r["text"])
    return Model(samples)


def predict(docs: DataFrame, model: Model, text_col: str = "text", kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``kept`` columns, ``lang_pred`` and ``score``."""
    K.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the samples: SAMPLE_TEXTS texts a language at most
    inner = [f"c{i}" for i in range(len(kept))]
    df = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(kept, inner, strict=True)), F.col(f"`{text_col}`").cast("string").alias("text"))
    types = dict(df.dtypes)

    def run(batches):
        m = shared.value
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                lang, score = m.predict(K.strings(piece.column("text")))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in inner), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*inner, "lang_pred", "score"])

    out = df.mapInArrow(run, "".join(f"{x} {types[x]}, " for x in inner) + "lang_pred string, score double")
    return out.select(*(F.col(x).alias(c) for c, x in zip(kept, inner, strict=True)), "lang_pred", "score")
