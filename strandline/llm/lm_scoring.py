"""Language-model scoring: exact unigram counts of the whole corpus, and a hashed maximum-entropy model over classes.

Counts: every task counts its words, Spark adds them up. A document's words find their counts in two ways that
together cover all words: words with at least ``FREQUENT`` of all tokens (so at most 1 / FREQUENT of them) are
broadcast, the others are joined on the word and summed back by row.

Model: P(word | history) = P(class | history) P(word | class). Classes: the end, the ``TOP`` most frequent words
one each, and the others by a hash of their last two characters. P(class | history) is a softmax over hashed
features: the last word, the last two, and the last but one (skip), in a table that grows with the training tokens.
It is trained by distributed gradient updates: in each round every task runs AdaGrad over its share of the training
documents, and the tasks' weights and squares are averaged by tokens, in blocks; the next round goes on from both, over
all training documents again. There are two tasks a core, so what they send grows as the table does. P(word | class) is
the smoothed share of the class's counts with one unseen word for each class. So probabilities over seen words and one
unseen word a class sum to one.

Defined cases: a null or empty text is one end token; a null id is learned from and not held out; repeated rows
count and are scored each; without training documents all counts are 0; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

FREQUENT = 2e-6
TOP, HASHED = 15, 8
CLASSES = 1 + TOP + HASHED
#: Feature buckets: one for so many training tokens, BUCKETS at least.
TOKENS, BUCKETS, BLOCK = 8192, 1 << 14, 1024
ROUNDS, BATCH, RATE, SALTS = 2, 16_384, 0.1, 32
#: Stands for the end; no word holds a space.
END = " "
_BEGIN, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def class_of(word: str, top: dict[str, int]) -> int:
    if word == END:
        return 0
    return top.get(word) or 1 + TOP + zlib.crc32(word[-2:].encode()) % HASHED


def classes_of(distinct: pa.Array, top: dict[str, int]) -> np.ndarray:
    """``class_of`` each word, with one call for each different pair of last characters."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    words = distinct.cast(pa.large_string())
    ends, codes = K.coded(pc.utf8_slice_codeunits(words, -2))
    out = np.array([1 + TOP + zlib.crc32(e.encode()) % HASHED for e in ends.to_pylist()], np.int64)[codes]
    own = pc.fill_null(pc.index_in(words, value_set=pa.array(list(top), pa.large_string())), -1).to_numpy(zero_copy_only=False)
    numbers = np.array([*top.values(), 0], np.int64)[own]
    return np.where(numbers > 0, numbers, np.where(pc.equal(words, END).to_numpy(zero_copy_only=False), 0, out))


def buckets_for(tokens: int) -> int:
    return max(BUCKETS, -(-tokens // (TOKENS * BLOCK)) * BLOCK)


def sequences(texts: pa.Array, top: dict[str, int], buckets: int = BUCKETS):
    """(distinct words, codes, first word of each text, class and three features of every token, text of every token)."""
    flat, at = K.split(texts, K.SPACED)
    distinct, codes = K.coded(flat)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n + 1)
    word = np.arange(len(doc)) - doc  # place among the words; an end takes the next text's
    last = np.zeros(len(doc), bool)
    last[np.cumsum(n + 1) - 1] = True
    cls, h = classes_of(distinct, top), K.summed_hashes(distinct)
    klass, place = np.zeros(len(doc), np.int64), np.full(len(doc), len(h))  # behind the words: the end, the beginning
    inner = codes[word[~last]] if len(codes) else np.zeros(0, np.int64)
    klass[~last], place[~last] = cls[inner], inner
    h = np.append(h, [_END, _BEGIN])
    before = [np.full(len(doc), len(h) - 1), np.full(len(doc), len(h) - 1)]
    for k in (1, 2):
        same = np.flatnonzero(doc[k:] == doc[:-k])
        before[k - 1][same + k] = place[same]
    a, b = before
    n = np.uint64(buckets)
    alone, skip = ((K.mix(h + np.uint64(x)) % n).astype(np.int64) for x in (1, 3))
    pair = K.mix((K.mix(h) * np.uint64(3))[b] + h[a] + np.uint64(2)) % n
    feats = np.stack([alone[a], pair.astype(np.int64), skip[b]])
    return distinct, codes, at, klass, feats, doc


def _softmax(w: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = w[f[0]] + w[f[1]] + w[f[2]] + bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def log_probabilities(w: np.ndarray, bias: np.ndarray, feats: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """log10 P(class | history) of every token, in batches."""
    out = np.empty(len(klass))
    for i in range(0, len(klass), BATCH):
        p = _softmax(w, bias, feats[:, i : i + BATCH])
        out[i : i + BATCH] = np.log10(np.maximum(p[np.arange(len(p)), klass[i : i + BATCH]], 1e-30))
    return out


def update(w: np.ndarray, squares: np.ndarray, bias: np.ndarray, feats: np.ndarray, klass: np.ndarray, rate: float = RATE) -> None:
    """One AdaGrad step on a batch, in place."""
    g = _softmax(w, bias, feats)
    g[np.arange(len(g)), klass] -= 1
    f = feats.ravel()
    order = np.argsort(f.astype(np.uint16), kind="stable")  # short integers are sorted by radix
    if len(w) > 1 << 16:
        order = order[np.argsort((f >> 16).astype(np.uint16)[order], kind="stable")]
    fs = f[order]
    first = np.flatnonzero(np.concatenate([[True], fs[1:] != fs[:-1]]))
    size = np.diff(first, append=len(fs))
    owner = order % g.shape[0]
    total, many = g[owner[first]], size > 1  # most features are met once
    if many.any():
        total[many] = np.add.reduceat(g[owner[np.repeat(many, size)]], np.cumsum(size[many]) - size[many])
    rows = fs[first]
    squares[rows] += total * total
    w[rows] -= rate * total / np.sqrt(squares[rows] + 1e-6)


def _counted(batches):
    """(word, c) summed in each slice, ends too."""
    for batch in batches:
        for piece in K.pieces(batch, "text"):
            distinct, codes = K.coded(K.split(K.strings(piece.column("text")), K.SPACED)[0])
            words = pa.concat_arrays([distinct.cast(pa.large_string()), pa.array([END], pa.large_string())])
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.append(np.bincount(codes, minlength=len(distinct)), piece.num_rows).astype(np.int64))], ["word", "c"])


def _class_sums(top: dict[str, int]):
    def run(batches):
        for batch in batches:
            k = classes_of(batch.column("word"), top)
            c = batch.column("c").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(np.bincount(k, c, CLASSES).astype(np.int64)), pa.array(np.bincount(k, minlength=CLASSES).astype(np.int64))], ["k", "n", "v"])

    return run


def _trained(shared):
    def run(batches):
        top, bias, start, state = shared.value
        w, squares, seen = start.copy(), state.copy(), 0
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                _, _, _, klass, feats, _ = sequences(K.strings(piece.column("text")), top, len(w))
                for i in range(0, len(klass), BATCH):
                    update(w, squares, bias, feats[:, i : i + BATCH], klass[i : i + BATCH])
                seen += len(klass)
        salt = TaskContext.get().partitionId() % SALTS
        for b in range(0, len(w) if seen else 0, BLOCK):
            raw = np.concatenate([w[b : b + BLOCK], squares[b : b + BLOCK]]) * np.float32(seen)
            yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([seen], pa.int64()), pa.array([raw.tobytes()], pa.binary())], ["block", "salt", "tokens", "sums"])

    return run


def _added(batches):
    """Sums of the blocks in this task, by (block, salt)."""
    sums: dict[tuple[int, int], list] = {}
    for batch in batches:
        for block, salt, tokens, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "tokens", "sums")), strict=True):
            s = sums.setdefault((block, salt), [0, np.zeros(2 * BLOCK * CLASSES, np.float64)])
            s[0] += tokens
            s[1] += np.frombuffer(raw, np.float32)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sums], pa.int32()), pa.array([s for _, s in sums], pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].astype(np.float32).tobytes() for v in sums.values()], pa.binary())], ["block", "salt", "tokens", "sums"])


_SUMS = "block int, salt int, tokens long, sums binary"


def _weights(training: DataFrame, top: dict[str, int], bias: np.ndarray, buckets: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class weights and their sums of squared gradients, after ``rounds`` over all of ``training``."""
    w = np.zeros((buckets, CLASSES), np.float32)
    squares = np.zeros_like(w)
    sc = training.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast((top, bias, w, squares))
        sums = training.select("text").coalesce(2 * sc.defaultParallelism).mapInArrow(_trained(shared), _SUMS)
        sums = sums.repartition("block", "salt").mapInArrow(_added, _SUMS)
        sums = sums.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(_added, _SUMS)
        w, squares = w.copy(), squares.copy()
        for row in sums.collect():
            b = row["block"] * BLOCK
            w[b : b + BLOCK], squares[b : b + BLOCK] = (np.frombuffer(row["sums"], np.float32) / np.float32(row["tokens"])).reshape(2, BLOCK, CLASSES)
    return w, squares


def _scored(shared, carried: list[str]):
    def run(batches):
        top, bias, w, frequent, logs, denominators = shared.value
        known = pa.array(frequent, pa.large_string())
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                distinct, codes, at, klass, feats, doc = sequences(K.strings(piece.column("text")), top, len(w))
                n_docs = piece.num_rows
                part = log_probabilities(w, bias, feats, klass) - denominators[klass]
                score = np.bincount(doc, part, n_docs)
                n = np.diff(at)
                word_doc = np.repeat(np.arange(n_docs), n)
                index = pc.fill_null(pc.index_in(distinct.cast(pa.large_string()), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
                each = index[codes] if len(codes) else index
                common = each >= 0
                freq = np.bincount(word_doc[common], logs[each[common]], n_docs)
                n_common = np.bincount(word_doc[common], minlength=n_docs)
                pair, count = np.unique((word_doc[~common].astype(np.int64) << 32) | codes[~common], return_counts=True)
                owner = pair >> 32
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(offsets), distinct.take(pa.array(pair & 0xFFFFFFFF)).cast(pa.string()))
                times = pa.ListArray.from_arrays(pa.array(offsets), pa.array(count.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carried), pa.array(n + 1), pa.array(freq), pa.array(n_common.astype(np.int64)), pa.array(score), rare, times], [*carried, "n_tokens", "freq", "n_common", "part", "rare", "times"])

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every document,
    learning from those that are not held out."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    df = docs.select(F.col(f"`{id_col}`").alias("id"), held_out.alias("held_out"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    training = df.where("NOT held_out")
    counts = scratch.table(training.select("text").mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))).first()
    n, v, ends = total
    top = {r["word"]: i + 1 for i, r in enumerate(counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(TOP).collect())}
    n_k, v_k = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.mapInArrow(_class_sums(top), "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n_k[r["k"]], v_k[r["k"]] = r["n"], r["v"]
    bias = np.log((n_k + 0.5) / (n_k + 0.5).sum()).astype(np.float32)
    w, _ = _weights(training, top, bias, buckets_for(n))
    common = counts.where((F.col("word") != END) & (F.col("c") >= max(1.0, FREQUENT * n))).toArrow()  # at most 1 / FREQUENT words
    words, logs = common.column("word").to_pylist(), np.log10(common.column("c").to_numpy().astype(float) + 0.1)
    shared = spark.sparkContext.broadcast((top, bias, w, words, logs, np.log10(n_k + 0.1 * (v_k + 1))))
    base = df.withColumn("rid", F.monotonically_increasing_id())
    carried = ["rid", "id", "held_out"]
    types = dict(base.dtypes)
    rows = base.select(*carried, "text").mapInArrow(_scored(shared, carried), ", ".join(f"{c} {types[c]}" for c in carried) + ", n_tokens long, freq double, n_common long, part double, rare array<string>, times array<int>")
    rows = scratch.table(rows, "rows")
    rare = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    out = rows.drop("rare", "times").join(found, "rid", "left")
    logs_sum = F.col("freq") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(math.log10(ends + 0.1))
    known = F.col("n_common") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs_sum - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))).alias("base_score"), (logs_sum + F.col("part")).alias("score"),
    )
