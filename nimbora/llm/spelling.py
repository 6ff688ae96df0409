"""Spelling variants: words one edit apart, found by scanning sorted lists.

A list of words is sorted once. For each word the list behind it is scanned with three cells of the
edit matrix a row (the diagonal and its neighbours). A row belongs to a prefix, so the rows of the
prefix that two adjacent entries share are used again, and where all three cells of a row exceed
one edit, every entry with that prefix is passed over.

No list is the whole vocabulary. Two words one edit apart agree before and behind the segment that
holds the edit: of the shorter length L, cut into segments [lo, hi), one holds the first place where
the words differ, and both words have the same first lo and the same last L - hi code points. So
words are dealt by (L, segment, what stands around it), and lists that are still long are dealt
again by halves of their segment, down to one code point.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import write_scratch

#: Segments of a word at first; lists of more entries are dealt again by halves of their segment.
PARTS, LIST_ENTRIES = 4, 512
FAR = 2


def near_pairs(words: list[str], shorter: int, low: int, high: int):
    """(i, j) of words of a sorted list that are one edit apart, the shorter of them with `shorter`
    code points, and that differ first in low:high."""
    shared = [0] * len(words) + [-1]  # code points shared with the entry before
    for j in range(1, len(words)):
        shared[j] = _prefix(words[j - 1], words[j])
    for i, word in enumerate(words[:-1]):
        n = len(word)
        padded = [None, *word, None, None]
        j, common = i + 1, shared[i + 1]
        rows = [(FAR, 0, 1)] + [(1, 0, 1)] * common
        while j < len(words):
            other, common = words[j], min(common, shared[j])
            t, end = len(rows) - 1, len(other)
            a, b, c = rows[t]
            while t < end:
                letter = other[t]
                a = min(a + (letter != padded[t]), b + 1)
                b = min(b + (letter != padded[t + 1]), c + 1, a + 1)
                c = min(c + (letter != padded[t + 2]), b + 1)
                t += 1
                if a > 1 and b > 1 and c > 1:
                    break
                rows.append((a, b, c))
            passed = len(rows) <= t
            if not passed and (a, b, c)[n - end + 1] == 1 and min(n, end) == shorter:
                if low <= min(common, shorter - 1) < high:
                    yield i, j
            j += 1
            while passed and shared[j] >= t:
                common = min(common, shared[j])
                j += 1
            del rows[shared[j] + 1 :]


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _segments(first: Column, last: Column, parts: int) -> Column:
    """Segments of first:last, of nearly equal length and none empty, for words as short as L."""
    cut = lambda i: (first + F.floor((last - first) * i / parts)).cast("int")
    all_parts = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(cut(i).alias("low"), cut(i + 1).alias("high"))
    )
    return F.filter(all_parts, lambda s: s["low"] < s["high"])


def _with_key(dealt: DataFrame) -> DataFrame:
    """Adds the name of the list: L, the segment, and the code points around it."""
    word = F.col("word")
    around = F.concat(
        word.substr(F.lit(1), F.col("low")),
        word.substr(F.length("word") - F.col("shorter") + F.col("high") + 1, F.length("word")),
    )
    name = F.concat_ws(".", "shorter", "low", "high")
    return dealt.withColumn("list", F.concat_ws(":", name, around))


def deal(counts: DataFrame, list_entries: int = LIST_ENTRIES) -> DataFrame:
    """(list, word, n, shorter, low, high): every word in each list that may hold a near word.

    A list has at most `list_entries` words, or its segment is a single code point. Then it holds at
    most one word for each letter, and one for each pair of letters: bounded by the alphabet.
    """
    size = F.length("word")
    lengths = F.explode(F.filter(F.array(size, size - 1), lambda x: x > 0)).alias("shorter")
    words = counts.select("word", "n", lengths)
    open_lists = _with_key(
        words.select("*", F.inline(_segments(F.lit(0), F.col("shorter"), PARTS)))
    )
    closed = []
    while True:
        sizes = open_lists.filter("high - low > 1").groupBy("list").agg(F.count(F.lit(1)).alias("entries"))
        long_lists, _ = write_scratch(sizes.filter(F.col("entries") > list_entries).select("list"), "long-lists")
        if long_lists.isEmpty():
            closed.append(open_lists)
            break
        closed.append(open_lists.join(long_lists, "list", "left_anti").select(open_lists.columns))
        again = open_lists.join(long_lists, "list", "left_semi")
        halves = F.inline(_segments(F.col("first"), F.col("last"), 2))
        again = again.select("word", "n", "shorter", F.col("low").alias("first"), F.col("high").alias("last"))
        open_lists, _ = write_scratch(_with_key(again.select("word", "n", "shorter", halves)), "dealt-again")
    dealt = closed[0]
    for more in closed[1:]:
        dealt = dealt.unionByName(more)
    return dealt


def near_words(counts: DataFrame, list_entries: int = LIST_ENTRIES) -> DataFrame:
    """(word, n_near, largest): for each word with near words their number, and (n, word) of the one
    that occurs most, the smallest in code-point order of equals."""
    import pyarrow as pa

    names = ["word", "n_near", "n", "near"]

    def answers(words, ns, name):
        shorter, low, high = map(int, name.split(":", 1)[0].split("."))
        number, best = [0] * len(words), [None] * len(words)
        for i, j in near_pairs(words, shorter, low, high):
            for x, y in ((i, j), (j, i)):
                number[x] += 1
                offer = (-ns[y], words[y])
                if best[x] is None or offer < best[x]:
                    best[x] = offer
        return [(words[i], k, -best[i][0], best[i][1]) for i, k in enumerate(number) if k]

    def batch_of(found):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names
        )

    def scan(batches):
        name, words, ns = None, [], []
        for batch in batches:
            found = []
            for list_name, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if list_name != name:
                    found += answers(words, ns, name) if len(words) > 1 else []
                    name, words, ns = list_name, [], []
                words.append(word)
                ns.append(n)
            yield batch_of(found)
        if len(words) > 1:
            yield batch_of(answers(words, ns, name))

    dealt = deal(counts, list_entries).select("list", "word", "n")
    lists = dealt.repartition("list").sortWithinPartitions("list", "word")
    found = lists.mapInArrow(scan, "word string, n_near long, n long, near string")
    largest = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), largest.alias("largest"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the end of each word's chain of forms.

    Chains are halved each round: a word takes over the target of its target. Forms occur at least
    `ratio` times as often as their words, so chains are short and without circles.
    """
    chain, _ = write_scratch(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        met = chain.join(onward, "root", "left")
        chain, _ = write_scratch(
            met.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")),
            "roots",
        )
        if chain.filter("moved").isEmpty():
            return chain.select("word", "root")


def spelling_variants(counts: DataFrame, ratio: int = 2, list_entries: int = LIST_ENTRIES) -> DataFrame:
    """One row per word of `counts` (word, n): word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A
    word's form is its near word of largest n (ties: the smallest in code-point order) if that is at
    least `ratio` times its own n, else null; root is the end of the chain of forms, the word itself
    if it has none. Words have to be distinct; null and empty words take no part; very long words
    are treated as any other; an empty table gives no rows. Other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or forms could run in circles")
    counts, _ = write_scratch(counts.select("word", "n").filter("word != ''"), "words")
    near = counts.join(near_words(counts, list_entries), "word", "left")
    largest_n = -F.col("largest.less")
    formed = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(largest_n >= ratio * F.col("n"), F.col("largest.word")).alias("form"),
        F.when(largest_n >= ratio * F.col("n"), largest_n).alias("form_n"),
    )
    formed, _ = write_scratch(formed, "formed")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
