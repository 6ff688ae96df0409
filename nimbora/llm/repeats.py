"""Periodic runs of words by internal pattern matching.

All texts of a slice are put one behind the other, each closed by a word of its own, and their
suffixes sorted by doubling. After each doubling equal blocks of 4, 8, 16 ... words hold one range
of the suffix array. A block asks a wavelet tree over that array for its next occurrence in the
neighbouring window, at most its own length away: both occurrences touch, so they are the start of
a progression, and its difference is the smallest period of the stretch they cover. The stretch is
then extended to the whole run.

Blocks of b words start at every multiple of b / 2. A run of period q and at least max(6, 4q) words
holds such a block with its next occurrence whole, b being the smallest of 4, 8, 16 ... not below
q: the block starts within b / 2 words of the run's start, and b / 2 - 1 + b + q <= max(6, 4q).
"""

from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbora.llm.common import slices

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Length of the smallest blocks. With LEAST_WORDS = 6 and LEAST_PERIODS = 4 none may be larger.
LEAST_BLOCK = 4
#: Texts are put together up to so many words; a longer text stands alone.
SLICE_WORDS = 200_000

RUNS = T.ArrayType(
    T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
)


class WaveletTree:
    """Numbers by their bits, highest first, one array of zero counts for each bit (a wavelet matrix)."""

    def __init__(self, values: np.ndarray):
        self.bits = int(values.max(initial=0)).bit_length()
        self.zeros, self.below = [], []
        for bit in reversed(range(self.bits)):
            is_zero = (values >> bit) & 1 == 0
            counts = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(is_zero, out=counts[1:])
            self.below.append(counts)
            self.zeros.append(counts[-1])
            values = np.concatenate([values[is_zero], values[~is_zero]])

    def _down(self, level: int, low, high, right):
        """The ranges on the next level: of the zeros, or of the ones where `right` is set."""
        low0, high0 = self.below[level][low], self.below[level][high]
        move = self.zeros[level]
        return np.where(right, low - low0 + move, low0), np.where(right, high - high0 + move, high0), high0 - low0

    def less(self, low, high, x):
        """How many values of each range low:high are smaller than x."""
        total, whole = np.zeros(len(low), dtype=np.int64), high - low
        for level in range(self.bits):
            right = (x >> (self.bits - 1 - level)) & 1 == 1
            low, high, zeros = self._down(level, low, high, right)
            total += np.where(right, zeros, 0)
        return np.where(x >> self.bits > 0, whole, total)

    def smallest(self, low, high, k):
        """The k-th smallest value of each range, from 0; k lies within the range."""
        value = np.zeros(len(low), dtype=np.int64)
        for level in range(self.bits):
            zeros = self.below[level][high] - self.below[level][low]
            right = k >= zeros
            k = np.where(right, k - zeros, k)
            value += right.astype(np.int64) << (self.bits - 1 - level)
            low, high, _ = self._down(level, low, high, right)
        return value

    def successor(self, low, high, x):
        """The smallest value >= x of each range low:high, or -1."""
        skipped = self.less(low, high, x)
        some = skipped < high - low
        found = np.full(len(low), -1, dtype=np.int64)
        found[some] = self.smallest(low[some], high[some], skipped[some])
        return found


def suffix_order(code: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """(suffix array, blocks): blocks has (length, starts, low, high) for each block length, with
    the ranges of the suffix array that hold the blocks' occurrences, more than one each.

    Every suffix must end in a value that occurs once, as each text's closing word does.
    """
    n = len(code)
    order = np.argsort(code, kind="stable")
    rank, end = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    slots, keys = np.arange(n), code[order]
    blocks, length = [], 1
    while True:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else slots
        sizes = np.diff(np.r_[first, len(keys)])
        at = order[slots]
        rank[at] = np.repeat(slots[first], sizes)
        end[at] = rank[at] + np.repeat(sizes, sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order, blocks
        at = order[slots]
        if length >= LEAST_BLOCK:
            starts = at[at % (length // 2) == 0]
            blocks.append((length, starts, rank[starts], end[starts]))
        # Equal blocks hold no closing word, so there is a word behind them.
        keys = rank[at] * n + rank[at + length]
        sort = np.argsort(keys, kind="stable")
        order[slots], keys = at[sort], keys[sort]
        length *= 2


def candidate_periods(order: np.ndarray, blocks, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each block whose next occurrence is at most its own length away.

    The suffixes of a text lie together, in the slots of its own words, so the tree holds the
    texts with repeated blocks only, as places within the text.
    """
    blocks = [b for b in blocks if len(b[1])]
    if not blocks:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    length = np.concatenate([np.full(len(b[1]), b[0]) for b in blocks])
    start, low, high = (np.concatenate([b[i] for b in blocks]) for i in (1, 2, 3))
    text = np.searchsorted(text_starts, start, side="right") - 1
    asked = np.unique(text)
    ends = np.r_[text_starts[1:], len(order)]
    sizes = ends[asked] - text_starts[asked]
    moved = np.cumsum(sizes) - sizes
    slots = np.repeat(text_starts[asked] - moved, sizes) + np.arange(sizes.sum())
    tree = WaveletTree(order[slots] - np.repeat(text_starts[asked], sizes))
    shift = (moved - text_starts[asked])[np.searchsorted(asked, text)]
    place = start - text_starts[text]
    period = tree.successor(low + shift, high + shift, place + 1) - place
    near = (period > 0) & (period <= length)
    return start[near], period[near]


def _equal(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading values agree."""
    done, step, n = 0, 32, min(len(left), len(right))
    while done < n:
        differs = left[done : min(n, done + step)] != right[done : min(n, done + step)]
        first = int(differs.argmax())
        if differs[first]:
            return done + first
        done += len(differs)
        step *= 2
    return n


def find_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period."""
    numbers: dict = defaultdict(count(1).__next__)
    sizes = np.array([len(words) + 1 for words in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    code = np.zeros(sizes.sum(), dtype=np.int64)
    for start, words in zip(starts, texts):
        code[start : start + len(words)] = list(map(numbers.__getitem__, words))
    code += np.repeat(np.arange(len(texts)), sizes) * (len(numbers) + 1)
    order, blocks = suffix_order(code)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begins, periods = candidate_periods(order, blocks, starts)
    last, reached = 0, 0
    for place in np.lexsort((begins, periods)):
        s, q = int(begins[place]), int(periods[place])
        if q == last and s + q < reached:  # in the run found before
            continue
        first = s - _equal(code[:s][::-1], code[q : s + q][::-1])
        last, reached = q, s + q + _equal(code[s:], code[s + q :])
        if reached - first >= max(LEAST_WORDS, LEAST_PERIODS * q):
            text = int(np.searchsorted(starts, s, side="right")) - 1
            found[text].append((first - int(starts[text]), reached - first, q))
    return [sorted(runs) for runs in found]


def collapse(words: list, runs) -> list:
    """The words, without those that follow the first period of a run that holds them."""
    if not runs:
        return words
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Callable | None = None
) -> DataFrame:
    """One row per input row: key, runs, collapsed.

    Words are what stands between ASCII white space. A run is a longest stretch of words with one
    smallest period q that has at least max(6, 4q) words; `runs` lists (start, length, period) by
    start, then period, `collapsed` is the text with each run cut to its first period, words joined
    by one space. `rewrite(key, words)` may replace the words of a text before they are searched.

    Null and empty texts have no runs and collapse to an empty text. Repeated rows are answered each
    for itself; a null key is kept; an empty table gives no rows. Other columns are not read, so
    their names are free. Very long texts are searched whole, alone in their slice, with memory in
    proportion to their words.
    """
    import pyarrow as pa

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("t"))
    run = pa.struct([(f.name, pa.int64()) for f in RUNS.elementType])

    def answer(keys, texts):
        runs = find_runs(texts)
        collapsed = [b" ".join(collapse(words, r)) for words, r in zip(texts, runs)]
        listed = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
        columns = [keys, pa.array(listed, pa.list_(run)), pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["key", "runs", "collapsed"])

    def search(batches):
        for batch in slices(batches):
            texts, first, held = [], 0, 0
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = (t or b"").split()
                if texts and held + len(words) > SLICE_WORDS:
                    yield answer(batch.column(0).slice(first, len(texts)), texts)
                    texts, first, held = [], i, 0
                texts.append(rewrite(k, words) if rewrite else words)
                held += len(words)
            if texts:
                yield answer(batch.column(0).slice(first, len(texts)), texts)

    schema = T.StructType(
        [T.StructField("key", rows.schema["key"].dataType), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    )
    return rows.mapInArrow(search, schema)
