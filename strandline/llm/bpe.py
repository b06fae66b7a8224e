"""BPE encoding and decoding through a table of the corpus's distinct words.

A text is cut into words where the tokenizer always cuts: before a single space between two characters that are neither
white nor beyond two bytes of UTF-8, and between an ASCII letter or digit and a common mark. So each word encodes alone
as it does within its text. Texts are taken in slices of some MB. The distinct words of a slice go, in packed blocks, to
the buckets of their hashes. A bucket encodes each distinct word of the corpus once, and its blocks go back with ids
in place of words. The slice's word positions, kept as packed numbers among its words, join the ids by position;
decoding joins all ids to the table of pieces. What is shuffled is a word for each slice it is in, and a packed number
for each position.

The slices are cut twice, for their words and for their positions, rather than written in between. So ``docs`` must give
the same rows in the same order twice, as files do; write the result of a shuffle first. Slices that differ are an error.

Defined cases: a null or empty text has no ids and decodes to an empty text; strings of special tokens within a
text become their ids, as in the library; repeated rows are encoded each; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Text bytes of a slice (one text at least).
SLICE = 6_000_000
#: Words encoded at a time.
TOGETHER = 20_000
#: Buckets of words for each partition of the documents, so that a bucket stays small however many documents there are.
SPREAD = 4
_MARKS = b",.;:!?)"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _vocabulary(path: str | None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def _tokenizer(vocabulary: str):
    """The library's tokenizer for the content of a vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces(vocabulary: str) -> list[bytes]:
    """The bytes of each id."""
    model = json.loads(vocabulary)
    if model.get("normalizer") is not None or model["pre_tokenizer"].get("add_prefix_space") or model["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("need a byte-level vocabulary without a normalizer and without a prefix space")
    if any(set(t["content"].encode()) & {0x20, *_MARKS} or t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
        raise ValueError("need added tokens without spaces and common marks that leave their surroundings alone")
    alphabet, tokenizer = byte_alphabet(), _tokenizer(vocabulary)
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return out


_AFTER, _BEFORE = np.zeros(256, bool), np.zeros(256, bool)
_AFTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_BEFORE[list(_MARKS)] = True


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order (together they are the texts), and each text's number of words."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    lead = (raw >= 0xC3) & (raw <= 0xDF)  # leads of two-byte characters, none of them white
    plain = (raw > 0x20) & (raw < 0x7F)
    ends = plain.copy()
    ends[1:] |= lead[:-1]
    starts = np.zeros(len(raw) + 1, bool)
    starts[1:-2] = ends[:-2] & (raw[1:-1] == 0x20) & (plain | lead)[2:]
    starts[1:-1] |= _AFTER[raw[:-1]] & _BEFORE[raw[1:]]
    starts[at[:-1][np.diff(at) > 0]] = True
    begin = np.flatnonzero(starts[: len(raw)])
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(np.append(begin, len(raw)).astype(np.int64)), pa.py_buffer(raw.tobytes())])
    return words, np.diff(np.searchsorted(begin, at))


def _packed(codes: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return pa.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Slice:
    """A slice of texts: its distinct words by bucket, and their numbers at all word positions."""

    def __init__(self, texts: pa.Array, n_buckets: int, index: int):
        words, self.n = cut(texts)
        distinct, codes = K.coded(words)
        bucket = (K.hashes(distinct) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.words, self.codes = distinct.take(pa.array(order)), number[codes]
        self.bucket, self.start = np.unique(bucket[order], return_index=True)
        digest = xxhash.xxh3_64()
        for t in texts.cast(pa.large_binary()).to_pylist():
            digest.update(len(t).to_bytes(8, "little") + t)
        self.name = f"{TaskContext.get().partitionId()}-{index}-{digest.hexdigest()}"

    def blocks(self) -> pa.RecordBatch:
        """(slice, bucket, n, lengths, letters) of each bucket."""
        at = _offsets(self.words)
        raw = memoryview(self.words.buffers()[2]) if len(self.words) else b""
        ends = np.append(self.start[1:], len(self.words))
        lengths = [_packed(np.diff(at[a : b + 1])) for a, b in zip(self.start, ends, strict=True)]
        letters = [pa.compress(raw[at[a] : at[b]], codec="zstd", asbytes=True) for a, b in zip(self.start, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([self.name] * len(ends)), pa.array(self.bucket), pa.array(ends - self.start), pa.array(lengths, pa.binary()), pa.array(letters, pa.binary())], ["slice", "bucket", "n", "lengths", "letters"])


def _offsets(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]


def _slices(batches, n_buckets: int):
    index = 0
    for batch in batches:
        for piece in K.pieces(batch, "text", SLICE):
            texts = K.strings(piece.column("text"))
            yield piece, texts, Slice(texts, n_buckets, index)
            index += 1


def _blocks(n_buckets: int):
    def run(batches):
        for _, _, one in _slices(batches, n_buckets):
            yield one.blocks()

    return run


def _positions(n_buckets: int, digest: bool):
    """A row for each slice: the documents' columns, numbers of words and text digests, and the packed word numbers."""

    def run(batches):
        for piece, texts, one in _slices(batches, n_buckets):
            sha = [hashlib.sha256(t).digest() for t in texts.cast(pa.large_binary()).to_pylist()] if digest else [b""] * len(texts)
            whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([one.name]), whole(piece.column("head")), whole(pa.array(one.n.astype(np.int64))), whole(pa.array(sha, pa.binary())), pa.array([_packed(one.codes)], pa.binary()), pa.array([len(one.words)])],
                ["name", "heads", "n", "sha", "codes", "distinct"],
            )

    return run


def _encoded_blocks(shared):
    """Blocks with ids in place of words, in order of buckets; each distinct word of a bucket is encoded once."""

    def run(batches):
        tokenizer, table, now = _tokenizer(shared.value), {}, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    table, now = {}, row["bucket"]
                at = np.concatenate([[0], np.cumsum(_unpacked(row["lengths"], row["n"]))])
                raw = pa.decompress(row["letters"], int(at[-1]), codec="zstd", asbytes=True)
                words = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                fresh = [w for w in words if w not in table]
                for i in range(0, len(fresh), TOGETHER):
                    part = fresh[i : i + TOGETHER]
                    for w, e in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                        table[w] = np.array(e.ids, "<u4").tobytes()
                ids = [table[w] for w in words]
                rows.append((row["slice"], row["bucket"], row["n"], _packed(np.array([len(x) // 4 for x in ids])), _packed(np.frombuffer(b"".join(ids), "<u4"))))
            names = ["slice", "bucket", "n", "lengths", "ids"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    return run


def _placed(shared, make, names: list[str]):
    """Ids and decoded bytes of every document of a slice, from the ids of its words."""

    def run(batches):
        table = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                value = lambda c: row.column(c).flatten()  # noqa: B023, E731
                heads, n, sha = value("heads"), value("n").to_numpy(zero_copy_only=False), value("sha")
                found = sorted(value("found").to_pylist(), key=lambda x: x["bucket"])
                if sum(x["n"] for x in found) != row.column("distinct")[0].as_py():
                    raise ValueError("the documents came in another order the second time: write them to a table first")
                lengths = [_unpacked(x["lengths"], x["n"]) for x in found]
                ids = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x["ids"], int(m.sum())) for x, m in zip(found, lengths, strict=True))]).astype("<u4")
                offsets = np.concatenate([[0], *lengths]).astype(np.int64).cumsum() * 4
                words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
                at = np.concatenate([[0], np.cumsum(n)])
                flat = words.take(pa.array(_unpacked(row.column("codes")[0].as_py(), int(at[-1]))))
                ids_at = _offsets(flat)[at] if at[-1] else at
                packed = memoryview(flat.buffers()[2])[: ids_at[-1]] if ids_at[-1] else memoryview(b"")
                plain = table.take(pa.array(np.frombuffer(packed, "<u4")))
                plain_at = _offsets(plain)[ids_at // 4] if ids_at[-1] else ids_at
                out = make(ids_at, packed, plain_at, memoryview(plain.buffers()[2]) if ids_at[-1] else packed, sha)
                yield pa.RecordBatch.from_arrays([heads, *out], ["head", *names])

    return run


def _lists(offsets: np.ndarray, data) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((offsets // 4).astype(np.int32)), pa.array(np.frombuffer(data, "<i4")[: offsets[-1] // 4]))


def _each(offsets: np.ndarray, data):
    return (data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def _decoded_sha(raw):
    """Digest of decoded bytes; what is no UTF-8 is replaced, as the library does."""
    return hashlib.sha256(bytes(raw).decode("utf-8", "replace").encode())


def _through_words(docs: DataFrame, kept: tuple[str, ...], text_col: str, vocabulary: str | None, fields: list[tuple[str, str]], make, digest: bool = False) -> DataFrame:
    spark = docs.sparkSession
    K.small_batches(spark)
    content = _vocabulary(vocabulary)
    shared, table = spark.sparkContext.broadcast(content), spark.sparkContext.broadcast(pieces(content))  # a few MB, whatever the data
    inner = [f"c{i}" for i in range(len(kept))]
    head = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(x) for c, x in zip(kept, inner, strict=True)))
    df = docs.select(head.alias("head"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(df.dtypes)["head"]
    n_buckets = SPREAD * max(df.rdd.getNumPartitions(), 1)
    blocks = df.mapInArrow(_blocks(n_buckets), "slice string, bucket long, n long, lengths binary, letters binary")
    blocks = blocks.repartition("bucket").sortWithinPartitions("bucket")
    blocks = blocks.mapInArrow(_encoded_blocks(shared), "slice string, bucket long, n long, lengths binary, ids binary")
    found = blocks.groupBy("slice").agg(F.collect_list(F.struct("bucket", "n", "lengths", "ids")).alias("found"))  # a slice's words
    rows = df.mapInArrow(_positions(n_buckets, digest), f"name string, heads array<{kind}>, n array<long>, sha array<binary>, codes binary, distinct long")
    rows = rows.join(found, F.col("name") == F.col("slice"), "left").drop("name", "slice").withColumn("found", F.coalesce("found", F.array()))
    out = rows.mapInArrow(_placed(table, make, [f for f, _ in fields]), f"head {kind}, " + ", ".join(f"{f} {t}" for f, t in fields))
    return out.select(*(F.col(f"head.{x}").alias(c) for c, x in zip(kept, inner, strict=True)), *(f for f, _ in fields))


def encoded(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",), text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``kept`` columns, ``n_tokens`` and ``ids``."""

    def make(offsets, ids, _offsets, _plain, _sha):
        return [pa.array(np.diff(offsets) // 4), _lists(offsets, ids)]

    return _through_words(docs, kept, text_col, vocabulary, [("n_tokens", "long"), ("ids", "array<int>")], make)


def round_trips(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",), text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``kept`` columns, ``n_tokens``, ``ids``, SHA-256 of the text decoded from the ids, and whether that is the text encoded."""

    def make(offsets, ids, plain_offsets, plain, sha):
        back = [_decoded_sha(raw) for raw in _each(plain_offsets, plain)]
        same = [b.digest() == a for a, b in zip(sha.to_pylist(), back, strict=True)]
        return [pa.array(np.diff(offsets) // 4), _lists(offsets, ids), pa.array([b.hexdigest() for b in back], pa.string()), pa.array(same, pa.bool_())]

    return _through_words(docs, kept, text_col, vocabulary, [("n_tokens", "long"), ("ids", "array<int>"), ("decoded_sha256", "string"), ("round_trip", "boolean")], make, True)


def round_trip_digests(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",), text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``kept`` columns, ``n_tokens``, and SHA-256 of the packed ids and of the text decoded from them."""

    def make(offsets, ids, plain_offsets, plain, _sha):
        digests = [hashlib.sha256(raw).hexdigest() for raw in _each(offsets, ids)]
        back = [_decoded_sha(raw).hexdigest() for raw in _each(plain_offsets, plain)]
        return [pa.array(np.diff(offsets) // 4), pa.array(digests, pa.string()), pa.array(back, pa.string())]

    return _through_words(docs, kept, text_col, vocabulary, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], make)


def decoded(ids: DataFrame, kept: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``kept`` columns and ``text`` of id arrays (null: empty), by a look-up of each id in the table of pieces, within batches."""
    K.small_batches(ids.sparkSession)
    shared = ids.sparkSession.sparkContext.broadcast(pieces(_vocabulary(vocabulary)))  # as long as the vocabulary
    inner = [f"c{i}" for i in range(len(kept))]
    df = ids.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(kept, inner, strict=True)), F.col(f"`{ids_col}`").alias("ids"))
    types = dict(df.dtypes)

    def run(batches):
        table = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            texts = [b"".join(table.take(pa.array(x or [], pa.int64())).to_pylist()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inner), pa.array(texts, pa.string())], [*inner, "text"])

    out = df.mapInArrow(run, "".join(f"{x} {types[x]}, " for x in inner) + "text string")
    return out.select(*(F.col(x).alias(c) for c, x in zip(kept, inner, strict=True)), "text")
