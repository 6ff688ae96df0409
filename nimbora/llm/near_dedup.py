"""Near-duplicate groups by a chosen-path set similarity join.

Documents become sets of word shingles. Documents with equal sets are one class; classes are
joined. Each class has `COORDINATES` minwise tokens. In each of `TREES` independent trees a node
chooses `BRANCH` coordinates from its own path, and a class goes to one child for each: the one
named by its token there. A pair of similarity s shares a child with chance 1 - (1 - s)**2 at
the first level, and over any number of levels at 0.8 shares one in some tree with chance above
0.99999. Nodes of up to `SMALL` classes are compared exhaustively, by a finer sketch of the sets;
larger ones are compared with two of their members and branch again, unless all their classes
are known to be in one group already, which is what ends large groups of near copies. Larger
nodes that are left after `LEVELS` levels are compared in full but for their largest known group
against itself. Every link is confirmed on the full sets of both texts.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import slices, worker_cache, write_scratch

COORDINATES = 48
TREES = 5
BRANCH = 2
SMALL = 256
LEVELS = 3
#: The rows of a larger node meet what is known of the node in so many parts.
SALTS = 16
#: The sketch of a set: a byte of the smallest hash in each of so many equal parts of the range.
BINS = 512
#: A pair is confirmed on full sets unless its sketches lie this many deviations below the
#: threshold: less than one linked pair in a hundred million is.
DEVIATIONS, MARGIN = 6.0, 0.01
#: Larger nodes at the last level are compared in blocks of so many classes.
BLOCK = 1024
#: Up to so many ids of texts to confirm are broadcast (8 bytes each); beyond it they are joined.
SENT_IDS = 2_000_000
MEMO_WORDS = 1_000_000
#: Shingles of the sets that a task remembers while it confirms pairs.
SETS_HELD = 5_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


# --- sets and minwise tokens ------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes; word hashes are remembered."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def words(self, text: str) -> np.ndarray:
        import xxhash

        # bytes.lower() and bytes.split() know ASCII only, which is what the contract names.
        words = text.encode("utf-8", "surrogatepass").lower().split()
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None, size: int) -> np.ndarray:
        words = self.words(text or "")
        if not len(words):
            return words
        n = max(1, len(words) - size + 1)
        mixed = np.full(n, min(size, len(words)), dtype=np.uint64)
        for i in range(min(size, len(words))):
            mixed = _mixed(mixed * ODD + words[i : i + n])
        return np.unique(mixed)


def shingler() -> Shingler:
    cache = worker_cache("near_dedup")
    if "shingler" not in cache:
        cache["shingler"] = Shingler()
    return cache["shingler"]


def minwise(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest hash of the set under each of the functions, 32 bits each."""
    low = np.full(len(factors), np.iinfo(np.uint32).max, dtype=np.uint32)
    for start in range(0, len(values), 4096):
        hashed = (values[start : start + 4096, None] * factors) >> np.uint64(32)
        np.minimum(low, hashed.min(axis=0).astype(np.uint32), out=low)
    return low


def sketch(values: np.ndarray) -> np.ndarray:
    """One byte for each bin of the sorted set, 0 where the bin is empty."""
    bins = (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins[first]] = 1 + values[first] % np.uint64(255)
    return out


def factors() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def document_sets(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(k, h, n_shingles, digest, tokens): key, hash of the text, and size, identity, minwise tokens
    and sketch of each set."""
    import pyarrow as pa

    odd = factors()

    def sets(batches):
        make = shingler()
        for batch in slices(batches):
            found = [make(t, size) for t in batch.column(2).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([minwise(s, odd).tobytes() + sketch(s).tobytes() if len(s) else None for s in found], pa.binary()),
                ],
                ["k", "h", "n_shingles", "digest", "tokens"],
            )

    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return rows.mapInArrow(sets, "k long, h long, n_shingles long, digest binary, tokens binary")


# --- the trees --------------------------------------------------------------


def _children(node: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Nodes below, (rows, BRANCH): the node's path chooses distinct coordinates."""
    at = _mixed(node * ODD)
    first = at % np.uint64(COORDINATES)
    out = np.empty((len(node), BRANCH), dtype=np.uint64)
    for b in range(BRANCH):
        step = np.uint64(b) * (np.uint64(1) + (at >> np.uint64(32)) % np.uint64(COORDINATES // BRANCH))
        coordinate = (first + step) % np.uint64(COORDINATES)
        value = tokens[np.arange(len(node)), coordinate.astype(np.int64)].astype(np.uint64)
        out[:, b] = _mixed(_mixed(node * ODD + coordinate + np.uint64(1)) + value * ODD)
    return out


def _roots() -> np.ndarray:
    return _mixed(np.arange(1, TREES + 1, dtype=np.uint64) * ODD)


def _stored(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 4 * COORDINATES + BINS)


def _tokens(column) -> np.ndarray:
    return np.ascontiguousarray(_stored(column)[:, : 4 * COORDINATES]).view(np.uint32)


def _sketches(column) -> np.ndarray:
    return _stored(column)[:, 4 * COORDINATES :]


def _long(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def first_level(classes: DataFrame) -> DataFrame:
    """(node, rep): the children of every root. Distinct coordinates for all trees."""
    import pyarrow as pa

    def nodes(batches):
        order = np.random.default_rng(3).permutation(COORDINATES)[: TREES * BRANCH]
        for batch in batches:
            if batch.num_rows:
                reps, tokens = _long(batch.column(0)), _tokens(batch.column(1))
                roots = np.repeat(_roots(), BRANCH)
                at = _mixed(roots * ODD + order.astype(np.uint64))
                node = _mixed(at[None, :] + tokens[:, order].astype(np.uint64) * ODD)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.ravel().view(np.int64)), pa.array(np.repeat(reps, len(order)))],
                    ["node", "rep"],
                )

    return classes.select("rep", "tokens").mapInArrow(nodes, "node long, rep long")


def next_level(held: DataFrame) -> DataFrame:
    """(rep, below) of classes with their larger nodes: the children of all of these."""
    import pyarrow as pa

    def nodes(batches):
        for batch in batches:
            if batch.num_rows:
                large = batch.column(1)
                each = np.diff(large.offsets.to_numpy())
                node = _long(large.flatten()).view(np.uint64)
                below = _children(node, np.repeat(_tokens(batch.column(2)), each, axis=0))
                ends = np.concatenate([[0], np.cumsum(each * BRANCH)]).astype(np.int32)
                children = pa.ListArray.from_arrays(pa.array(ends), pa.array(below.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), children], ["rep", "below"])

    return held.select("rep", "large", "tokens").mapInArrow(nodes, "rep long, below array<long>")


def _similar(n1, s1, n2, s2, least):
    """Rows that may link, by size and sketch.

    A bin that either set fills shows the smallest hash of the union there, which both sets have
    with the chance of their similarity. The bins are a sample of the union without repetition.
    """
    t = least / 100
    fits = np.minimum(n1, n2) >= np.maximum(n1, n2) * t - 1e-9
    filled = np.maximum(((s1 | s2) != 0).sum(axis=-1), 1)
    equal = ((s1 == s2) & (s1 != 0)).sum(axis=-1)
    left = np.maximum(0, 1 - filled * (1 + t) / (n1 + n2))
    floor = t - DEVIATIONS * np.sqrt(t * (1 - t) / filled * left) - MARGIN - 1 / filled
    return fits & (equal >= filled * floor)


def small_pairs(small: DataFrame, least: int) -> DataFrame:
    """(a, b) of candidates within nodes of at most SMALL rows, all rows of a node compared."""
    import pyarrow as pa

    def pairs(batches):
        held = None
        for batch in _with_end(batches):
            if batch is not None and batch.num_rows:
                new = [_long(batch.column(i)) for i in range(4)] + [_sketches(batch.column(4))]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None:
                continue
            node = held[0]
            # The last node may go on in the next batch.
            cut = len(node) if batch is None else int(np.flatnonzero(node != node[-1])[-1:].sum() + 1) * bool((node != node[-1]).any())
            done, held = [x[:cut] for x in held], [x[cut:] for x in held]
            a, b = _within(*done, least)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    ordered = small.repartition("node").sortWithinPartitions("node")
    return ordered.select("node", "rep", "comp", "n", "tokens").mapInArrow(pairs, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def _within(node, rep, comp, n, tokens, least):
    """Candidates among rows sorted by node: rows compared with the first, second, ... below."""
    first, second, live = [], [], np.arange(len(node))
    for d in range(1, SMALL):
        live = live[live + d < len(node)]
        live = live[node[live] == node[live + d]]
        if not len(live):
            break
        for start in range(0, len(live), 8192):
            i = live[start : start + 8192]
            i = i[(comp[i] != comp[i + d]) & (rep[i] != rep[i + d])]
            i = i[_similar(n[i], tokens[i], n[i + d], tokens[i + d], least)]
            first.append(np.minimum(rep[i], rep[i + d]))
            second.append(np.maximum(rep[i], rep[i + d]))
    return (np.concatenate(first), np.concatenate(second)) if first else (np.array([], np.int64),) * 2


def _compare(rows: DataFrame, least: int) -> DataFrame:
    """(a, b) that may link, of rows (rep, n, tokens) and two others in the same row."""
    import pyarrow as pa

    def keep(batches):
        for batch in slices(batches, 2048):
            if not batch.num_rows:
                continue
            a, n1, s1 = _long(batch.column(0)), _long(batch.column(1)), _sketches(batch.column(2))
            for at in (3, 6):
                b, n2, s2 = _long(batch.column(at)), _long(batch.column(at + 1)), _sketches(batch.column(at + 2))
                ok = _similar(n1, s1, n2, s2, least) & (a != b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], ["a", "b"]
                )

    return rows.mapInArrow(keep, "a long, b long")


def leader_pairs(large: DataFrame, least: int) -> DataFrame:
    """Candidates between the rows of larger nodes and two members of the same node."""
    # Each task offers its own first and last row of a node, so a large node sends a few rows.
    row = F.struct("comp", "n", "tokens")
    leaders = (
        large.groupBy(F.col("node").alias("at"))
        .agg(
            F.min("rep").alias("rep1"),
            F.max("rep").alias("rep2"),
            F.min_by(row, "rep").alias("one"),
            F.max_by(row, "rep").alias("two"),
        )
        .select(
            "at",
            *(F.col(f"{name}.{c}").alias(f"{c}{i}") for i, name in ((1, "one"), (2, "two")) for c in ("comp", "n", "tokens")),
            "rep1",
            "rep2",
        )
        .withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # A node may hold a third of all rows: each is met by its leaders under every salt.
    salted = large.withColumn("salt", _salt())
    other = (F.col("comp") != F.col("comp1")) | (F.col("comp") != F.col("comp2"))
    met = salted.join(leaders, (F.col("node") == F.col("at")) & (F.col("salt") == F.col("salt2")) & other)
    fields = ["rep", "n", "tokens", "rep1", "n1", "tokens1", "rep2", "n2", "tokens2"]
    return _compare(met.select(fields), least)


def last_pairs(large: DataFrame, least: int) -> DataFrame:
    """Candidates in larger nodes at the last level: rows outside a node's largest known group
    against all its rows, a block of about BLOCK of these with a block of about BLOCK of those.
    Nodes of one group have no such rows."""
    import pyarrow as pa

    groups = large.groupBy("node", "comp").count()
    biggest = F.max_by(F.struct("comp", "count"), F.struct("count", "comp"))
    main = groups.groupBy("node").agg(biggest.alias("main"), F.sum("count").alias("all"))
    main = main.filter("main.count < all").select(
        "node",
        F.col("main.comp").alias("main"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("all") - F.col("main.count")) / BLOCK).cast("int").alias("other_blocks"),
    )
    rows = large.join(main, "node")

    def placed(count):
        return F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    all_rows = rows.withColumns({"block": placed("blocks"), "side": F.lit(0)}).withColumn("other", every("other_blocks"))
    others = (
        rows.filter(F.col("comp") != F.col("main"))
        .withColumns({"other": placed("other_blocks"), "side": F.lit(1)})
        .withColumn("block", every("blocks"))
    )
    fields = ["node", "block", "other", "side", "rep", "comp", "n", "tokens"]
    both = all_rows.select(fields).unionByName(others.select(fields))

    def compare(keys, table):
        side = table.column("side").to_numpy()
        rep, comp, n = (table.column(c).to_numpy() for c in ("rep", "comp", "n"))
        tokens = _sketches(table.column("tokens"))
        here, a, b = np.flatnonzero(side == 0), [], []
        for i in np.flatnonzero(side == 1):
            j = here[comp[here] != comp[i]]
            j = j[_similar(n[i], tokens[i], n[j], tokens[j], least)]
            a.append(np.minimum(rep[i], rep[j]))
            b.append(np.maximum(rep[i], rep[j]))
        return pa.table({"a": np.concatenate(a or [rep[:0]]), "b": np.concatenate(b or [rep[:0]])})

    return both.groupBy("node", "block", "other").applyInArrow(compare, "a long, b long")


# --- links and groups -------------------------------------------------------


def confirm(pairs: DataFrame, docs: DataFrame, size: int, least: int, text: str) -> DataFrame:
    """The pairs of text hashes whose full sets have 100 * intersection >= least * union."""
    import pyarrow as pa

    def check(batches):
        make, sets, held = shingler(), {}, 0
        for batch in slices(batches):
            a, b = _long(batch.column(0)), _long(batch.column(1))
            keep = np.zeros(len(a), dtype=bool)
            for i, two in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if held > SETS_HELD:
                    sets, held = {}, 0
                for t in two:
                    if t not in sets:
                        sets[t] = make(t, size)
                        held += len(sets[t])
                one, other = sets[two[0]], sets[two[1]]
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep[i] = 100 * both >= least * (len(one) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    texts = docs.select(F.xxhash64(text).alias("k"), F.col(text).alias("t"))
    ids = pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct()
    ids, _ = write_scratch(ids, "pair-ids")
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    # A text that many rows hold leaves each task once.
    texts = texts.join(ids, F.col("k") == F.col("i"), "left_semi").groupBy("k").agg(F.first("t").alias("t"))
    first = texts.withColumnsRenamed({"k": "a", "t": "ta"})
    second = texts.withColumnsRenamed({"k": "b", "t": "tb"})
    # Pairs of two long texts meet in small Arrow batches; rows come sorted by a.
    met = pairs.join(second, "b").join(first, "a").select("a", "b", "ta", "tb")
    return met.mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex reachable, for every vertex of a link.

    Labels take the smallest of their neighbours' and then their label's own label, until
    nothing changes; each round is written, so lineage stays short.
    """
    both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a"))
    edges, _ = write_scratch(both.distinct(), "links")
    labels, _ = write_scratch(
        edges.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("comp")),
        "labels",
    )
    while True:
        near = (
            edges.join(labels.select(F.col("v").alias("u"), F.col("comp").alias("c")), "u")
            .groupBy("v")
            .agg(F.min("c").alias("c"))
        )
        lower = labels.join(near, "v").select("v", "comp", F.least("comp", "c").alias("c"))
        up = labels.select(F.col("v").alias("c"), F.col("comp").alias("top"))
        jumped = lower.join(up, "c").select("v", F.least("c", "top").alias("comp"), (F.least("c", "top") < F.col("comp")).alias("changed"))
        written, _ = write_scratch(jumped, "labels")
        labels = written.select("v", "comp")
        if not written.filter("changed").limit(1).count():
            return labels


def near_duplicates(
    docs: DataFrame, shingle: int = 5, least: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    Words are what ASCII white space separates after A-Z are lower-cased. A set holds the
    distinct shingles of `shingle` words; a shorter text is one shingle; without words the set is
    empty and linked with nothing. Rows link where 100 * intersection >= least * union;
    component_id is the smallest key reachable, kept marks the row that has it. Rows with one key
    are one document: all kept or none, linked by each of their texts. Rows with a null key are
    linked with nothing, have a null component_id and are kept. An empty table gives no rows.
    Other columns are not read.
    """
    sets, _ = write_scratch(document_sets(docs, shingle, key, text), "sets")
    usable = sets.filter(F.col("k").isNotNull() & F.col("digest").isNotNull())
    # Rows of one digest have one set, so any of them gives the class its size and tokens. A class
    # is named by the hash of one of its texts, as keys may repeat with different texts.
    classes, _ = write_scratch(
        usable.groupBy("digest").agg(
            F.min("h").alias("rep"),
            F.min("k").alias("least"),
            F.first("n_shingles").alias("n"),
            F.first("tokens").alias("tokens"),
        ),
        "classes",
    )
    links = _links(classes.select("rep", "n", "tokens"), docs, shingle, least, text)
    groups = components(links).withColumnRenamed("v", "rep")
    members = classes.select("digest", "least", "rep").join(groups, "rep", "left")
    smallest = members.filter("comp is not null").groupBy("comp").agg(F.min("least").alias("low"))
    named = members.join(smallest, "comp", "left").select(
        F.col("digest").alias("d"), F.coalesce("low", "least").alias("group")
    )
    labelled = sets.drop("tokens", "h").join(named, F.col("digest") == F.col("d"), "left")
    # One key with several texts ties their groups together.
    linked = labelled.filter(F.col("group").isNotNull() & F.col("k").isNotNull()).select("k", "group")
    several = linked.groupBy("k").agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a < b")
    several, _ = write_scratch(several.select("k", "a"), "several")
    if several.limit(1).count():
        tied = linked.distinct().join(several, "k").filter("group > a")
        tied, _ = write_scratch(tied.select("a", F.col("group").alias("b")).distinct(), "tied")
        top = components(tied).select(F.col("v").alias("group"), F.col("comp").alias("top"))
        labelled = labelled.join(top, "group", "left").withColumn("group", F.coalesce("top", "group"))
    component = F.when(F.col("k").isNotNull(), F.coalesce("group", "k"))
    return labelled.select(
        F.col("k").alias("key"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"),
    )


def sized(rows: DataFrame) -> DataFrame:
    """Rows (node, rep, comp) of the nodes that hold several groups, with the node's size.

    Nodes of up to SMALL rows that hold the same classes give the same pairs, so one of them is
    kept; they are known by size, groups and 64-bit hashes of their classes. A node has one count,
    so no row is made twice. Nodes of more than SMALL rows, any of which may hold a third of all,
    meet theirs under every salt.
    """
    counts = (
        rows.groupBy("node")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("comp").alias("c1"),
            F.max("comp").alias("c2"),
            F.bit_xor(F.xxhash64("rep")).alias("who"),
        )
        .filter("c1 < c2")
    )
    # A larger node branches by its own path, whatever else holds its classes.
    own = F.when(F.col("size") > SMALL, F.col("node")).alias("own")
    counts = counts.groupBy("size", "c1", "c2", "who", own).agg(F.min("node").alias("node")).select("node", "size")
    # Written, so that Spark knows their size: where they are few, no row moves to meet them.
    counts, _ = write_scratch(counts, "nodes")
    small = rows.join(counts.filter(F.col("size") <= SMALL), "node")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = counts.filter(F.col("size") > SMALL).withColumn("salt", salts)
    large = rows.withColumn("salt", _salt()).join(salted, ["node", "salt"]).drop("salt")
    return small.unionByName(large)


def _salt():
    return F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")


def _links(base, docs, shingle, least, text):
    """Confirmed links between classes, enough of them for the groups."""

    def confirmed(pairs):
        distinct, _ = write_scratch(pairs.distinct(), "pairs")
        out, _ = write_scratch(confirm(distinct, docs, shingle, least, text), "confirmed")
        return out

    def grouped(links):
        groups = components(links).withColumnRenamed("v", "rep")
        return base.select("rep").join(groups, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def level_of(lean, base):
        """Candidates of a level, its classes (rep, n, tokens, large) with their larger nodes of
        several groups, and the rows of these nodes. A class meets its tokens once, whatever the
        number of its nodes."""
        # Counting and keeping both read the nodes, so they are made once, without tokens.
        lean, _ = write_scratch(lean, "children")
        fits = F.col("size") <= SMALL
        nodes = sized(lean).groupBy("rep").agg(
            F.first("comp").alias("comp"),
            F.collect_list(F.when(fits, F.col("node"))).alias("small"),
            F.collect_list(F.when(~fits, F.col("node"))).alias("large"),
        )
        nodes, _ = write_scratch(nodes, "nodes-of")
        if nodes.count() <= SENT_IDS:
            base = base.join(F.broadcast(nodes.select("rep")), "rep", "left_semi")
        held, _ = write_scratch(nodes.join(base, "rep"), "level")
        small, large = (held.select(F.explode(c).alias("node"), "rep", "comp", "n", "tokens") for c in ("small", "large"))
        large, _ = write_scratch(large, "large")
        pairs = small_pairs(small, least).unionByName(leader_pairs(large, least))
        return pairs, held.filter(F.size("large") > 0).select("rep", "n", "tokens", "large"), large

    pairs, held, large = level_of(first_level(base).withColumn("comp", F.col("rep")), base)
    links = confirmed(pairs)
    if not large.limit(1).count():
        return links
    # Nodes whose classes are in one group by now have such children only, which `sized` drops.
    classes, _ = write_scratch(grouped(links), "grouped")
    found = None
    for _level in range(2, LEVELS + 1):
        below = next_level(held).join(classes, "rep").select(F.explode("below").alias("node"), "rep", "comp")
        pairs, held, large = level_of(below, held.drop("large"))
        found = pairs if found is None else found.unionByName(pairs)
        if not large.limit(1).count():
            return links.unionByName(confirmed(found))
    links = links.unionByName(confirmed(found))
    large, _ = write_scratch(large.drop("comp").join(grouped(links), "rep"), "level")
    return links.unionByName(confirmed(last_pairs(large, least)))
