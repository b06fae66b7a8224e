"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled texts: those whose document frequency is much
higher among toxic ones. Features of a text: lexicon densities and weights, lexicon words close to a second
person, second person, capitals, punctuation, repetition and obfuscation rates, and length. Trees are fitted to
the logistic loss on histograms; isotonic regression on texts of its own turns their sums into probabilities.

Training takes a bounded sample of ``SAMPLE`` labelled documents by hash of the id: half for the lexicon, three
tenths for the trees, a fifth for calibration, so that no part is judged on what it has learned from.

Defined cases: a null or empty text has features of its own (length 0) and so a low score; several labels of one
id count as toxic if any is; null labels are no labels; without labels, or with one class only, every score is the
share of toxic labels (0 without labels); repeated rows are scored each; empty tables give empty tables; extra
columns are ignored (``kept`` ones stay).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

SAMPLE = 16_000
TERMS, LEAST_TEXTS, LEAST_ODDS = 3000, 3, 2.0
STEMS = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Pronouns of the second person in a few languages (fixed list).
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú usted ustedes tus vosotros".split())
#: Characters that stand for letters in obfuscated words (fixed list).
LOOKALIKE = str.maketrans("013457@$!|", "oleastasil")
_EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "“”„«»…–—¿¡"
FEATURES = ("lexicon_density", "lexicon_count", "weight_density", "max_weight", "stem_density", "stem_weight", "near_second_person", "second_person", "capitals", "exclamations", "punctuation", "digits", "obfuscated", "obfuscated_lexicon", "repeated", "log_words")


def term_weights(token: str, words: dict[str, float], stems: dict[str, float]) -> tuple[float, float, float, float, float]:
    """Word weight, stem weight, second person, obfuscated, obfuscated lexicon word - of one lower-cased token."""
    core = token.strip(_EDGE).lower()
    if not core:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    word = words.get(core, 0.0)
    stem = max((stems.get(core[:k], 0.0) for k in STEMS if len(core) >= k), default=0.0)
    hidden = known = 0.0
    if not core.isalpha() and any(c.isalpha() for c in core):
        plain = "".join(c for c in core.translate(LOOKALIKE) if c.isalpha())
        hidden = float(plain != "".join(c for c in core if c.isalpha()) or "*" in core or "." in core)
        known = words.get(plain, 0.0) if hidden else 0.0
    return word, stem, float(core in SECOND_PERSON), hidden, known


_KINDS = np.zeros((4, 256), np.float32)
_KINDS[0, 0x41:0x5B] = 1
_KINDS[1, 0x21] = 1
_KINDS[2, [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 1
_KINDS[3, 0x30:0x3A] = 1


def features(texts: pa.Array, words: dict[str, float], stems: dict[str, float]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    n_docs = len(texts)
    flat, at = K.split(texts, K.SPACED)
    distinct, codes = K.coded(flat)
    tokens = distinct.to_pylist()
    per = np.array([term_weights(t, words, stems) for t in tokens], np.float64).reshape(-1, 5)
    size = np.diff(at)
    n = np.maximum(size, 1)
    doc = np.repeat(np.arange(n_docs), size)
    each = per[codes] if len(codes) else np.zeros((0, 5))
    total = lambda x: np.bincount(doc, x, n_docs)
    lexical = (each[:, 0] > 0).astype(float)
    most = np.zeros(n_docs)
    if len(codes):
        np.maximum.at(most, doc[lexical > 0], each[lexical > 0, 0])
    second = np.concatenate([[0], np.cumsum(each[:, 2])])
    where = np.flatnonzero(lexical > 0)
    close = second[np.minimum(where + 4, at[doc[where] + 1])] - second[np.maximum(where - 3, at[doc[where]])] if len(where) else np.zeros(0)
    near = np.bincount(doc[where], (close > 0).astype(float), n_docs) if len(where) else np.zeros(n_docs)
    again = np.zeros(len(codes))
    if len(codes) > 1:
        again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n_docs + 1] if n_docs else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n_docs and texts.buffers()[2] else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    chars = np.zeros((4, n_docs))
    full = np.flatnonzero(length > 0)
    if len(full):
        for k in range(4):
            chars[k, full] = np.add.reduceat(_KINDS[k][raw], (offsets[:-1] - offsets[0])[full])
    chars /= np.maximum(length, 1)
    return np.stack(
        [total(lexical) / n, np.log1p(total(lexical)), total(each[:, 0]) / n, most, total((each[:, 1] > 0).astype(float)) / n, total(each[:, 1]) / n, near / n, total(each[:, 2]) / n, chars[0], chars[1], chars[2], chars[3], total(each[:, 3]) / n, total(each[:, 4]) / n, total(again) / n, np.log1p(size)],
        axis=1,
    )


@dataclass
class Trees:
    """Boosted trees of fixed depth; level-wise arrays of split feature and cut, and leaf values."""

    base: float = 0.0
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        rows = np.arange(len(bins))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(bins), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, n_bins: int = 48, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms."""
    quantiles = np.quantile(x, np.linspace(0, 1, n_bins + 1)[1:-1], axis=0).T
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Trees(float(np.log(p / (1 - p))), np.ascontiguousarray(quantiles), [], depth)
    bins = model.binned(x)
    score = np.full(len(y), model.base)
    n_features = x.shape[1]
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, n_bins, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = (node - first)[:, None] * n_bins + bins
            best = np.full(width, 1e-6)
            for j in range(n_features):
                gs = np.bincount(slot[:, j], g, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                hs = np.bincount(slot[:, j], h, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least * 0.05) | (ht - hs < least * 0.05)] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = at[better]
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
        leaf_id = node - (2**depth - 1)
        leaf = -rate * np.bincount(leaf_id, g, 2**depth) / (np.bincount(leaf_id, h, 2**depth) + l2)
        model.trees.append((feature, cut, leaf))
        score += leaf[leaf_id]
    return model


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and values of the monotone fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # value, weight, first x, last x
    for xi, yi in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([yi, 1.0, xi, xi])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v, w, _, last = blocks.pop()
            b = blocks[-1]
            b[0] = (b[0] * b[1] + v * w) / (b[1] + w)
            b[1] += w
            b[3] = last
    knots = [(b[k], b[0]) for b in blocks for k in (2, 3)]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(self.trees.binned(features(texts, self.words, self.stems)))
        if self.knots is None:
            return 1 / (1 + np.exp(-raw))
        return 0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw))


def _terms_of(batches):
    """(kind, term, toxic, texts) summed in each slice, for words and word beginnings of each text."""
    for batch in batches:
        for piece in K.pieces(batch, "text"):
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False)
            flat, at = K.split(K.strings(piece.column("text")), K.SPACED)
            distinct, codes = K.coded(flat)
            cores = [t.strip(_EDGE).lower() for t in distinct.to_pylist()]
            count: dict[tuple[int, str], list[int]] = {}
            for d in range(len(at) - 1):
                own = {cores[c] for c in np.unique(codes[at[d] : at[d + 1]]).tolist()} - {""}
                for key in {(0, w) for w in own} | {(1, w[:k]) for w in own for k in STEMS if len(w) >= k}:
                    c = count.setdefault(key, [0, 0])
                    c[0] += int(toxic[d])
                    c[1] += 1
            if count:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in count], pa.int32()), pa.array([t for _, t in count], pa.string()), pa.array([c[0] for c in count.values()], pa.int64()), pa.array([c[1] for c in count.values()], pa.int64())], ["kind", "term", "t", "n"])


def _rows_of(shared):
    def run(batches):
        words, stems = shared.value
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                x = features(K.strings(piece.column("text")), words, stems).astype(np.float64)
                yield pa.RecordBatch.from_arrays([piece.column("part"), piece.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["part", "toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from all labels given; pass training rows only."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    by_id = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    by_id = by_id.groupBy("id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    drawn = by_id.withColumn("h", F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40))).orderBy("h", "id").limit(sample)
    drawn = scratch.table(drawn.select("id", "toxic", (F.col("h") % 10).cast("int").alias("part")), "drawn")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(drawn), "id")  # at most ``sample`` ids
    rows = scratch.table(texts.groupBy("id").agg(F.first("toxic").alias("toxic"), F.first("part").alias("part"), F.min("text").alias("text")).drop("id"), "sample")
    size = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), *(F.count_if(F.col("part") < 5) if k is None else F.coalesce(F.sum(F.when(F.col("part") < 5, F.col("toxic"))), F.lit(0)) for k in (None, 1))).first()
    total, toxic, n_lex, t_lex = size
    share = toxic / total if total else 0.0
    if not total or toxic in (0, total):
        return Model({}, {}, None, None, share)
    terms = rows.where("part < 5").select("toxic", "text").mapInArrow(_terms_of, "kind int, term string, t long, n long").groupBy("kind", "term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    t, n = F.col("t"), F.col("n")
    odds = F.log((t + 0.5) / (t_lex + 1.0)) - F.log((n - t + 0.5) / (n_lex - t_lex + 1.0))
    strong = terms.where((t >= LEAST_TEXTS)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for r in strong.orderBy(F.desc(F.col("odds") * F.sqrt(t)), "kind", "term").limit(TERMS).collect():
        (stems if r["kind"] else words)[r["term"]] = r["odds"]
    shared = spark.sparkContext.broadcast((words, stems))  # at most TERMS terms
    got = rows.where("part >= 5").select("part", "toxic", "text").mapInArrow(_rows_of(shared), "part int, toxic int, x array<double>").collect()  # half of ``sample`` rows of numbers
    got.sort(key=lambda r: (r["part"], r["toxic"], tuple(r["x"])))
    x, y, part = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float), np.array([r["part"] for r in got])
    fit = part < 8
    if not fit.any() or y[fit].min() == y[fit].max():
        return Model(words, stems, None, None, share)
    trees = fit_trees(x[fit], y[fit])
    rest = ~fit
    knots = isotonic(trees.raw(trees.binned(x[rest])), y[rest]) if rest.sum() >= 50 and y[rest].min() != y[rest].max() else None
    return Model(words, stems, trees, knots, share)


def _scored(docs: DataFrame, model: Model, text_col: str, kept: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """(``kept`` columns by names of their own, and ``score``; the names)."""
    K.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = {c: "text" if c == text_col else f"c{i}" for i, c in enumerate(kept)}
    df = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in inner.items() if x != "text"), F.col(f"`{text_col}`").cast("string").alias("text"))
    types = dict(df.dtypes)

    def run(batches):
        m = shared.value
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                score = m.score(K.strings(piece.column("text")))
                yield pa.RecordBatch.from_arrays([*(piece.column(x) for x in inner.values()), pa.array(score, pa.float64())], [*inner.values(), "score"])

    return df.mapInArrow(run, "".join(f"{x} {types[x]}, " for x in inner.values()) + "score double"), inner


def scored(docs: DataFrame, model: Model, text_col: str = "text", kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``kept`` columns and ``score``."""
    out, inner = _scored(docs, model, text_col, kept)
    return out.select(*(F.col(x).alias(c) for c, x in inner.items()), "score")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, whatever the names of their columns."""
    out, inner = _scored(docs, model, text_col, tuple(docs.columns))
    return out.where(F.col("score") < threshold).select(*(F.col(x).alias(c) for c, x in inner.items()))
