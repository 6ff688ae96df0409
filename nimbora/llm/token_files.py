"""Token-id files: one concatenated id array with Elias-Fano coded document ends.

A file set is a Parquet folder of blocks. A block holds the ids of consecutive documents as
one binary (two bytes an id where the vocabulary allows it) and the ends of its documents as
an Elias-Fano sequence: about 2 + log2(ids / documents) bits a document instead of a 64-bit
table. Blocks are written through Spark's committer, so a lost executor costs a retry only.
"""

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbora.llm.common import slices
from nimbora.llm.tokens import encoder

#: A block ends with the document that reaches this many ids.
BLOCK_IDS = 1 << 20
#: Every so many ones the position of a one is stored, for select.
SELECT_STEP = 256

BLOCK = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("base", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("id_bytes", T.IntegerType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("ids", T.BinaryType()),
        T.StructField("low_bits", T.IntegerType()),
        T.StructField("low", T.BinaryType()),
        T.StructField("high", T.BinaryType()),
        T.StructField("samples", T.BinaryType()),
    ]
)


#: Places of the ones of each byte, from its highest bit.
ONES = [tuple(k for k in range(8) if byte >> (7 - k) & 1) for byte in range(256)]


class EliasFano:
    """A non-decreasing sequence of n numbers up to u in about n * (2 + log2(u / n)) bits.

    Each number is split into `low_bits` low bits, stored as they are, and its high part,
    stored in unary: the i-th one of `high` stands at (high part + i).
    """

    def __init__(self, n, low_bits, low, high, samples):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        samples = ones[::SELECT_STEP].astype("<u4")
        return cls(n, low_bits, low.tobytes(), np.packbits(bits).tobytes(), samples.tobytes())

    def _low(self, i: int) -> int:
        first, width = i * self.low_bits, self.low_bits
        some = self.low[first >> 3 : (first + width + 7) >> 3]
        bits = int.from_bytes(some) >> (len(some) * 8 - (first & 7) - width) & ((1 << width) - 1)
        return int(f"{bits:0{width}b}"[::-1], 2) if width else 0

    def select(self, i: int) -> int:
        """The i-th number: from the nearest stored one, count ones up to the i-th."""
        at = int.from_bytes(self.samples[i // SELECT_STEP * 4 :][:4], "little")
        left, place = i % SELECT_STEP, at >> 3
        byte = self.high[place] & (0xFF >> (at & 7))
        while (ones := byte.bit_count()) <= left:
            left, place = left - ones, place + 1
            byte = self.high[place]
        at = place * 8 + ONES[byte][left]
        return ((at - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """Every number, for readers of whole blocks."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8)))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        count = self.n * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8))[:count]
        weights = 1 << np.arange(self.low_bits, dtype=np.int64)
        return high | bits.reshape(self.n, self.low_bits).astype(np.int64) @ weights


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode whole texts and write them in ascending key order, `end_id` after each.

    A null or empty text is the end id alone. Rows are range-sorted by key, then hash of the text,
    before they are encoded, so each text is encoded once; null keys come first, repeated keys follow
    each other. An empty table gives a folder without blocks. Other columns are not read.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(BLOCK)

    def blocks(batches):
        coder = encoder(tokenizer_path)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        width = len(end)
        shard, number, base = TaskContext.get().partitionId(), 0, 0
        keys, parts, ends, total = [], [], [], 0

        def block():
            ef = EliasFano.encode(np.array(ends))
            row = {
                "shard": shard, "block": number, "base": base, "n_ids": total,
                "id_bytes": width, "keys": keys, "ids": b"".join(parts),
                "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "samples": ef.samples,
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k, ids in zip(batch.column(0).to_pylist(), coder.encode(texts)):
                keys.append(k)
                parts += (ids, end)
                total += len(ids) // width + 1
                ends.append(total)
                if total >= block_ids:
                    yield block()
                    number, base = number + 1, base + total
                    keys, parts, ends, total = [], [], [], 0
        if keys:
            yield block()

    rows = docs.select(
        F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")
    )
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t")
    ordered.select("k", "t").mapInArrow(blocks, BLOCK).write.option("compression", "zstd").parquet(path)


def read_token_files(
    spark: SparkSession, path: str, with_ids: bool = False, keys: DataFrame | None = None
) -> DataFrame:
    """One row per document: key, start (ids of all documents before it), n_tokens, ids_crc32,
    and `ids` where asked for. With `keys` (a column `key`) the documents of these keys alone.

    Where a document lies in its block is asked of the block's boundaries by select, one document
    at a time; nothing else of the block is decoded. A shard's start is the sum of the shards before
    it: one row for each writing task. Null keys are never asked for; repeated ones count once.
    """
    import pyarrow as pa

    from pyspark.sql import Window

    stored = spark.read.schema(BLOCK).parquet(path)
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select(
        F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    fields = "key long, start long, n_tokens long, ids_crc32 long"
    columns = ["first", "base", "id_bytes", "keys", "ids", "low_bits", "low", "high", "samples", "asked"]

    def documents(batches):
        for batch in slices(batches, 8):
            for row in batch.to_pylist():
                names, asked = row["keys"], row["asked"]
                ef = EliasFano(len(names), row["low_bits"], row["low"], row["high"], row["samples"])
                places = range(len(names)) if asked is None else [i for i, k in enumerate(names) if k in set(asked)]
                starts = np.array([ef.select(i - 1) if i else 0 for i in places], dtype=np.int64)
                ends = np.array([ef.select(i) for i in places], dtype=np.int64)
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['id_bytes']}").astype("<u4")
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                first = row["first"] + row["base"]
                out = [
                    pa.array([names[i] for i in places], pa.int64()),
                    pa.array(starts + first),
                    pa.array(ends - starts),
                    pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    out.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, ends)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["key", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    # One row for each writing task: small whatever the input, so it may be broadcast.
    placed = stored.join(F.broadcast(starts), F.col("shard") == F.col("s"))
    if keys is None:
        placed = placed.withColumn("asked", F.lit(None).cast("array<bigint>"))
    else:
        # Which blocks hold which of the keys: a block's keys are in range order, its texts stay put.
        held = stored.select("shard", "block", F.explode("keys").alias("key"))
        wanted = held.join(keys.select("key").distinct(), "key")
        asked = wanted.groupBy("shard", "block").agg(F.collect_set("key").alias("asked"))
        placed = placed.join(asked, ["shard", "block"])
    placed = placed.select(columns)
    return placed.mapInArrow(documents, fields + (", ids array<int>" if with_ids else ""))
