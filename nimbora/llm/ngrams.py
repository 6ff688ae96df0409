"""Hashed character n-grams, vectorised over one text at a time."""

import numpy as np


def hashed_ngrams(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket of every character n-gram of the given sizes, in [0, 2**bits)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = []
    for size in sizes:
        n = len(points) - size + 1
        if n < 1:
            continue
        h = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def fold(key_column, parts: int):
    """crc32 of the key's text, modulo `parts`."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(key_column.cast("string").cast("binary")), F.lit(parts))


def bounded_sample(rows, per_class: int, class_column: str, key: str):
    """At most `per_class` rows of each class, those with the smallest key hashes."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    # First within salts, so that no task sorts all rows of a class.
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key, F.lit("salt")), F.lit(16)))
    for groups in ([class_column, "_salt"], [class_column]):
        order = Window.partitionBy(*groups).orderBy(F.xxhash64(key), key)
        salted = salted.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= per_class).drop("_place")
    return salted.drop("_salt")
