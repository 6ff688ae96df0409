"""Nearest neighbours by multi-index hashing over learned rotated binary codes."""

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import write_scratch
from nimbora.llm.vectors import (
    CANDIDATES,
    answers,
    best,
    block_of,
    blocks_for,
    matrix,
    meet,
    members,
    query_classes,
    usable,
)

#: Bound of the sample that codes and radius are learned from.
SAMPLE = 8192
CODE_BITS = 256
SUBSTRING = 8
ROUNDS = 25
#: The radius holds this share of the sample's true neighbours.
KEPT = 0.99


@dataclass
class Codes:
    """`rotation` (dimensions, bits) after `mean`; `radius` in bits."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """Bytes of the codes, one substring a byte."""
        return np.packbits((unit - self.mean) @ self.rotation > 0, axis=1)


def learn(sample: np.ndarray, k: int, bits: int = CODE_BITS, seed: int = 7) -> Codes:
    """Rotations that bring the sample close to its signs: from several random starts, the
    rotation and the signs are fitted to each other in turn, on the principal axes. Each start
    gives as many bits as there are dimensions."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    d = unit.shape[1]
    axes = np.linalg.svd(np.cov((unit - mean).T).reshape(d, d))[0]
    centred, parts = (unit - mean) @ axes, []
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(centred.T @ np.where(centred @ turn > 0, 1.0, -1.0))
            turn = u @ v
        parts.append(axes @ turn)
    codes = Codes(mean, np.hstack(parts)[:, :bits], bits)
    packed = codes(unit)
    distances = []
    for i in range(0, len(unit), max(1, len(unit) // 256)):
        score = unit @ unit[i]
        score[i] = -2
        near = np.argsort(-score)[:k]
        distances += list(np.bitwise_count(packed[near] ^ packed[i]).sum(axis=1))
    codes.radius = int(np.quantile(distances, KEPT)) if distances else bits
    return codes


def _balls() -> list[np.ndarray]:
    """Bytes within each radius of zero, by radius."""
    out, so_far = [], [0]
    for r in range(SUBSTRING + 1):
        if r:
            so_far = so_far + [sum(1 << b for b in c) for c in combinations(range(SUBSTRING), r)]
        out.append(np.array(so_far))
    return out


class MultiIndex:
    """One bucket table for each substring of the codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.bounds = np.stack(
            [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order.T)]
        )
        self.balls = _balls()

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of every code within the Hamming radius.

        With m substrings and radius m * s + a, a code within it is within s of the query in one
        of the first a + 1 substrings or within s - 1 in one of the others.
        """
        m = len(code)
        near, extra = divmod(min(radius, m * SUBSTRING), m)
        seen = np.zeros(len(self.codes), dtype=bool)
        for j in range(m):
            reach = near if j <= extra else near - 1
            if reach < 0:
                break
            values = self.balls[min(reach, SUBSTRING)] ^ int(code[j])
            starts, ends = self.bounds[j][values], self.bounds[j][values + 1]
            counts = ends - starts
            shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            seen[self.order[:, j][np.arange(len(shift)) + shift]] = True
            if seen.all():
                break
        found = np.flatnonzero(seen)
        distance = np.bitwise_count(self.codes[found] ^ code).sum(axis=1)
        return found[distance <= radius]


def search(
    rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by cosine.

    Null, zero and mismatched vectors and vectors with null or non-finite components take no part;
    vectors of another than the most common length are mismatched. A query is not its own
    neighbour; equal vectors are neighbours of each other; ties go to the smaller id; repeated rows
    count once. Fewer than k other vectors: all of them. An empty table gives no rows. Other
    columns are not read. Every vector is indexed; codes and radius come from a sample of at most
    SAMPLE vectors. Where a block holds fewer than k + 1 codes within the radius, the radius is
    widened there.
    """
    import pyarrow as pa

    nonzero = lambda df: df.filter(F.exists("v", lambda x: x != 0))
    given = nonzero(usable(rows, key, vector))
    classes, _ = write_scratch(members(given, k + 1), "classes")
    reps = classes.filter(F.col("id") == F.col("rep")).select("rep", "v")
    count = reps.count()
    sample = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow()
    width = max((len(x) for x in sample.column("v").slice(0, 1).to_pylist()), default=0)
    asked = nonzero(usable(queries, key, vector)).filter(F.size("v") == width)
    qreps, asked = query_classes(asked)
    qreps, _ = write_scratch(qreps, "queries")
    codes = learn(matrix(sample.column("v")), k) if count > 1 else None

    def one(asked_table, given_table):
        ids = given_table.column("rep").to_numpy()
        unit = matrix(given_table.column("v"))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        q_ids, q_unit = asked_table.column("qrep").to_numpy(), matrix(asked_table.column("v"))
        q_unit /= np.linalg.norm(q_unit, axis=1, keepdims=True)
        out = ([], [], [])
        index = MultiIndex(codes(unit)) if codes else None
        q_codes = codes(q_unit) if codes else [None] * len(q_ids)
        for q, q_code, q_id in zip(q_unit, q_codes, q_ids):
            place = np.arange(len(ids))
            if index is not None:
                radius = codes.radius
                place = index.within(q_code, radius)
                while len(place) < min(k + 1, len(ids)):
                    radius = radius * 2 + 1
                    place = index.within(q_code, radius)
            scores = np.clip((unit[place] * q).sum(axis=1), -1, 1)
            top = best(scores, ids[place], k + 1)
            out[0].append(np.full(len(top), q_id))
            out[1].append(ids[place][top])
            out[2].append(scores[top])
        return pa.table({n: np.concatenate(c) for n, c in zip(("qrep", "rep", "score"), out)})

    blocks = blocks_for(count, CANDIDATES)
    placed = reps.withColumn("block", block_of("rep", blocks))
    found = meet(placed, qreps, qreps.count(), range(blocks), one, "qrep long, rep long, score double")
    return answers(found, classes, asked, k)
