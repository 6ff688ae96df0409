"""Packing along a space-filling curve: documents sorted by the Hilbert key of their
projected vectors are laid end to end and cut into sequences."""

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nimbora.llm.common import slices, write_scratch
from nimbora.llm.tokens import encoder

SEQUENCE = 2048
BUCKETS = 1024
DIMENSIONS = 4
BITS = 15


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points, shape (n, d), with d * bits < 64.

    From the top bit down, each axis first undoes the reflection or exchange that the
    higher bits put on the axes below it; a Gray code then orders the cells.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for bit in range(bits - 1, 0, -1):
        mask = (1 << bit) - 1
        for axis in range(d):
            high = (x[axis] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[axis]) & mask)
            x[0] ^= np.where(high, mask, swap)
            x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    flips = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where((x[d - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flips
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(d):
            keys = keys << 1 | (x[axis] >> bit) & 1
    return keys


class Projector:
    """Ids hashed into count vectors of unit length, projected by one fixed random matrix."""

    def __init__(self, vocabulary: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bucket = rng.permutation(vocabulary) % BUCKETS
        self.matrix = rng.standard_normal((BUCKETS, DIMENSIONS))

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        vectors = np.zeros((len(documents), BUCKETS))
        for i, ids in enumerate(documents):
            vectors[i] = np.bincount(self.bucket[ids], minlength=BUCKETS)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        # A logistic curve spreads the roughly normal coordinates over the grid.
        spread = 1 / (1 + np.exp(-1.702 * (vectors @ self.matrix)))
        return hilbert_keys(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    length: int = SEQUENCE,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the piece's `ids` where asked for.

    All documents lie end to end in order of (Hilbert key, key, row) and are cut every `length`
    ids, so every sequence but the last is full. A null or empty text is the end id alone. Rows
    with one key, null keys among them, are packed each for itself; copies share a Hilbert key
    and become neighbours. An empty table gives no pieces. Other columns are not read.

    Texts are encoded once. What is sorted over all documents is (curve key, key, row, count);
    the key of a row and the row break ties, so copies do not gather in one partition. A
    running count in each range partition and one total per partition place every document.
    """
    import pyarrow as pa

    def encode(batches):
        coder = encoder(tokenizer_path)
        projector = Projector(coder.tokenizer.get_vocab_size())
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            ids = [b + end for b in coder.encode(texts)]
            arrays = [np.frombuffer(b, dtype=coder.dtype) for b in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(projector.keys(arrays)),
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array([coder.tokenizer.get_vocab_size()] * len(ids), pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["row", "k", "curve", "n", "vocabulary", "ids"],
            )

    def running(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            counts = batch.column(1).to_numpy()
            ends = total + np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([part] * len(counts), pa.int32()),
                    pa.array(ends - counts),
                    batch.column(1),
                ],
                ["r", "part", "before", "m"],
            )
            total = int(ends[-1]) if len(ends) else total

    def pieces(batches):
        for batch in slices(batches):
            out = {c: [] for c in names}
            for k, n, vocabulary, ids, at in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(ids, "<u2" if vocabulary <= 1 << 16 else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    take = min(n - start, length - offset)
                    part = values[start : start + take]
                    row = [k, start, take, zlib.crc32(part.tobytes()), n, sequence, offset]
                    for c, v in zip(names, row + [part.astype(np.int32)] * with_ids):
                        out[c].append(v)
                    start += take
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c, v in out.items()],
                list(out),
            )

    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names += ["ids"] * with_ids
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("k"),
        F.col(text).alias("t"),
    )
    schema = "row long, k long, curve long, n long, vocabulary long, ids binary"
    tokens, _ = write_scratch(rows.mapInArrow(encode, schema), "pack-ids")
    order = ["curve", "k", "row"]
    lean = tokens.select("row", "n", "curve", "k")
    ranged = lean.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n")
    placed, _ = write_scratch(
        ranged.mapInArrow(running, "r long, part int, before long, m long"), "pack-order"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("m").alias("total"))
    starts = totals.select(
        F.col("part").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first")
    )
    # One row for each range partition: small whatever the input, so it may be broadcast.
    positions = placed.join(F.broadcast(starts), F.col("part") == F.col("p")).select(
        "r", (F.col("first") + F.col("before")).alias("at")
    )
    joined = tokens.join(positions.hint("shuffle_hash"), F.col("row") == F.col("r"))
    fields = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in names)
    return joined.select("k", "n", "vocabulary", "ids", "at").mapInArrow(pieces, fields)
