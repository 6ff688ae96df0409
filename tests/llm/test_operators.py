"""Operators against plain Python on small tables with nulls, empty texts, copies and ties."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.llm import (
    inner_product, language, licenses, multi_index, near_dedup, packing, personal_data, pieces,
    token_files, tokens, toxicity,
)
from nimbora.session import scratch_path

P = pytest.importorskip("public_tokenizers")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    base = [prose(rng, 60) for _ in range(12)]
    near = [t.rsplit(" ", 1)[0] + " omega" for t in base[:5]]
    odd = [None, "", "a", "two words", "  spaces \n\n and\ttabs  ", "naïve café 漢字 😀", "x " * 3000]
    return list(enumerate(base + near + base[:3] + odd))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", "clash") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, score string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def full_ids(path, text):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return model.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_equal_whole_ids(name, texts):
    path = P.path(name)
    odd = ["a  b", "a   b ", " lead", "don't  stop\n \nnow", "x  y", "Ünḯ cøde", "<|endoftext|> z", "a\x1c b"]
    coder = tokens.ChunkEncoder(path, memo_chunks=50)
    for text in [t or "" for _, t in texts] + odd:
        assert np.frombuffer(coder.encode([text])[0], coder.dtype).tolist() == full_ids(path, text), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_chunks_go_to_the_model_word_by_word(name):
    from tokenizers import Tokenizer

    path, rng = P.path(name), np.random.default_rng(6)
    library = Tokenizer.from_file(path)
    signs = [*"aB1é ÉßÞ×÷ªµ!#'|<\n\t\x1c\x00\x7f", "'s", "'LL", "  ", "e\u0301", "İ", "Σ", "漢", "</w>", "Ġ", "\u2028"]
    some = ["".join(rng.choice(signs, rng.integers(1, 12))) for _ in range(3000)]
    coder = tokens.ChunkEncoder(path, memo_chunks=200, memo_words=100)
    for text, ids in zip(some, coder.encode(some)):
        assert np.frombuffer(ids, coder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text
    want = full_ids(path, "Grüße, new words! don't 12 stop")
    coder.tokenizer = None  # plain chunks do without the steps before the model
    ids = coder.encode(["Grüße, new words! don't 12 stop"])[0]
    assert np.frombuffer(ids, coder.dtype).tolist() == want


def test_a_worker_holds_the_memory_of_one_operator():
    from nimbora.llm.common import worker_cache

    first = worker_cache("one")
    first["kept"] = 1
    assert worker_cache("one") is first
    assert worker_cache("other") == {} and worker_cache("one") == {}


def test_elias_fano_selects_every_number():
    rng = np.random.default_rng(2)
    for values in ([], [0], [5], [1] * 700, np.cumsum(rng.integers(0, 900, 1500))):
        ef = token_files.EliasFano.encode(np.array(values, dtype=np.uint64))
        assert [ef.select(i) for i in range(ef.n)] == list(values) == ef.all().tolist()


def test_token_files_round_trip(spark, docs, empty, texts):
    path, folder = P.path("byte_bpe_50k.json"), scratch_path(spark, "t")
    token_files.write_token_files(docs, folder, path, 2, block_ids=300)
    got = {r["key"]: r for r in token_files.read_token_files(spark, folder, with_ids=True).collect()}
    start = 0
    for key, text in texts:
        ids = full_ids(path, text) + [2]
        row = got.pop(key)
        assert (row["start"], row["n_tokens"], row["ids"]) == (start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        if key == 3:
            third = (row["start"], row["n_tokens"], row["ids"])
    assert not got
    asked = spark.createDataFrame([(3,), (3,), (None,), (999,)], "key long")
    (row,) = token_files.read_token_files(spark, folder, with_ids=True, keys=asked).collect()
    assert (row["key"], row["start"], row["n_tokens"], row["ids"]) == (3, *third)
    folder = scratch_path(spark, "t")
    token_files.write_token_files(empty, folder, path, 2)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_hilbert_keys_are_a_path_through_every_cell():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing_is_gapless_and_whole(docs, empty, texts):
    path = P.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, 1, length=64, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["key"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for key, text in texts:
        own = sorted(by_doc[key], key=lambda r: r["start"])
        assert sum((r["ids"] for r in own), []) == full_ids(path, text) + [1]
    for number, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or number == max(by_sequence)
    assert packing.pack(empty, path, 1).count() == 0


def brute_groups(rows, size, least):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        last = max(0, len(words) - size)
        sets[key] = {tuple(words[i : i + size]) for i in range(last + 1)} if words else set()
    group = {k: k for k in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= least * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    return {k: (len(sets[k]), group[k], group[k] == k) for k in sets}


@pytest.mark.parametrize("small", [256, 2])
def test_near_duplicates_equal_brute_force(monkeypatch, docs, empty, texts, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = near_dedup.near_duplicates(docs, 4, 80).collect()
    got = {r["key"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == len(texts) and got == brute_groups(texts, 4, 80)
    if small > 2:
        assert near_dedup.near_duplicates(empty, 4, 80).count() == 0


def test_repeated_keys_link_by_each_of_their_texts(spark):
    """Links of every text of a key; null keys and equal texts tie nothing together."""
    rng = np.random.default_rng(19)
    text = [prose(rng, 60) + f" topic{i} " + prose(rng, 20) for i in range(9)]
    near = [t + " end" for t in text]
    rows = [(1, text[0]), (1, text[1]), (2, near[0]), (3, near[1]), (3, near[1])]
    rows += [(14, text[2]), (14, text[3]), (14, text[4]), (5, near[2]), (6, near[3]), (7, near[4])]
    rows += [(8, text[5]), (9, text[6]), (None, text[5]), (None, text[6]), (None, text[0]), (10, text[7]), (11, None), (11, text[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {}
    for r in near_dedup.near_duplicates(docs, 4, 80).collect():
        got.setdefault(r["key"], set()).add((r["component_id"], r["kept"]))
    want = {1: 1, 2: 1, 3: 1, 14: 5, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10, 11: 11}
    assert got == {k: {(c, c == k)} for k, c in want.items()} | {None: {(None, True)}}


def test_a_large_node_meets_its_size_in_many_tasks(spark):
    rng = np.random.default_rng(6)
    large = [(7, int(r), int(r)) for r in rng.integers(0, 1 << 60, 4000)]
    small = [(n, r, r) for n in range(100, 120) for r in range(n, n + 3)]
    rows = spark.createDataFrame(large + small + [(8, r, 1) for r in range(300)] + [(9, 1, 1)], "node long, rep long, comp long")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = near_dedup.sized(rows).select("node", "rep", "comp", "size", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Nodes of one group go, the others keep each row once.
    assert sorted((r["node"], r["rep"], r["comp"]) for r in got) == sorted(large + small)
    assert all(r["size"] == (4000 if r["node"] == 7 else 3) for r in got)
    tasks = Counter(r["at"] for r in got if r["node"] == 7)
    assert len(tasks) > 4 and max(tasks.values()) < 2000


def test_small_nodes_of_the_same_classes_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    same = [(n, r, r) for n in range(10) for r in (1, 2, 3)]
    other = [(20, 1, 1), (20, 2, 2), (21, 1, 1), (21, 3, 3), (21, 4, 4), (22, 1, 1), (22, 3, 3), (22, 5, 5)]
    large = [(n, r, r) for n in (30, 31) for r in range(100, 105)]
    rows = spark.createDataFrame(same + other + large, "node long, rep long, comp long").repartition(4)
    got = sorted((r["node"], r["rep"], r["comp"]) for r in near_dedup.sized(rows).collect())
    # Larger nodes branch by paths of their own, so both stay.
    assert got == sorted(same[:3] + other + large)


def test_children_of_a_class_are_made_in_one_row(spark):
    rng = np.random.default_rng(8)
    tokens = rng.integers(0, 1 << 32, (3, near_dedup.COORDINATES), dtype=np.uint32)
    nodes = [[5, -7, 11], [5], [-7, 13]]
    rows = [(i, n, bytearray(t.tobytes() + b"\0" * near_dedup.BINS)) for i, (n, t) in enumerate(zip(nodes, tokens))]
    held = spark.createDataFrame(rows, "rep long, large array<long>, tokens binary").coalesce(1)
    got = {r["rep"]: r["below"] for r in near_dedup.next_level(held).collect()}
    for i, own in enumerate(nodes):
        below = near_dedup._children(np.array(own, np.int64).view(np.uint64), tokens[[i] * len(own)])
        assert got[i] == below.ravel().view(np.int64).tolist()


def test_groups_of_the_last_level_are_bounded(spark, monkeypatch):
    from pyspark.sql import GroupedData

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(12)
    empty = b"\0" * 4 * near_dedup.COORDINATES
    looks = [rng.integers(1, 256, near_dedup.BINS, dtype=np.uint8).tobytes() for _ in range(4)]
    # A main group of 60 rows, and 140 rows that are a group each.
    rows = [(9, i, 0 if i < 60 else i, 100, bytearray(empty + looks[i % 4])) for i in range(200)]
    large = spark.createDataFrame(rows, "node long, rep long, comp long, n long, tokens binary")
    counts = "keys string, rows long"
    with monkeypatch.context() as m:
        import pyarrow as pa

        size = lambda keys, table: pa.table({"keys": [str(keys)], "rows": [table.num_rows]})
        run = GroupedData.applyInArrow
        for kind in {GroupedData, type(large.groupBy("node"))}:
            m.setattr(kind, "applyInArrow", lambda self, f, schema: run(self, size, counts))
        sizes = [r["rows"] for r in near_dedup.last_pairs(large, 80).collect()]
    assert len(sizes) > 50 and max(sizes) <= 5 * near_dedup.BLOCK
    got = {(r["a"], r["b"]) for r in near_dedup.last_pairs(large, 80).collect()}
    comp = [0 if i < 60 else i for i in range(200)]
    assert got == {(a, b) for a, b in combinations(range(200), 2) if a % 4 == b % 4 and comp[a] != comp[b]}


def test_rows_without_key_are_kept(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["key"] or 0, r["component_id"], r["kept"]) for r in rows if r["key"]) == [(1, 1, True)]
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["key"] is None)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (404, [1.0]), (405, [])]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")


def exact(rows, asked, score, k, zero):
    kept = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and len(v) == 8 and None not in v}
    kept = {i: v for i, v in kept.items() if np.isfinite(v).all() and (zero or v.any())}
    for q in sorted(set(kept) & asked):
        order = sorted((-score(kept[q], v), i) for i, v in kept.items() if i != q)
        yield from ((q, r, i, -s) for r, (s, i) in enumerate(order[:k], 1))


def test_inner_products_are_exact(monkeypatch, vectors):
    monkeypatch.setattr(inner_product, "CANDIDATES", 64)
    rows, table = vectors
    ints = lambda v: np.floor(v * 1024).astype(int)
    want = list(exact(rows, {0, 7, 305, 401}, lambda a, b: int(ints(a) @ ints(b)), 10, True))
    got = inner_product.search(table, table.filter("vec_id in (0, 7, 305, 401)")).collect()
    assert sorted(map(tuple, got)) == want
    assert inner_product.search(table.filter("false"), table).count() == 0


def test_multi_index_recall_and_scores(vectors):
    rows, table = vectors
    asked = {i for i in range(0, 406, 5)}
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    want = {(q, i): s for q, _, i, s in exact(rows, asked, cosine, 5, False)}
    got = multi_index.search(table, table.filter("vec_id % 5 = 0")).collect()
    hits = {(r["query_id"], r["vec_id"]) for r in got} & set(want)
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    assert all(abs(r["score"] - want[k]) < 1e-12 for r in got if (k := (r["query_id"], r["vec_id"])) in want)
    assert multi_index.search(table.filter("false"), table).count() == 0


def test_multi_index_finds_every_code_within_the_radius():
    codes = np.random.default_rng(5).integers(0, 256, (500, 4), dtype=np.uint8)
    index = multi_index.MultiIndex(codes)
    for radius in (0, 3, 9, 14, 32):
        distance = np.bitwise_count(codes ^ codes[3]).sum(axis=1)
        assert index.within(codes[3], radius).tolist() == np.flatnonzero(distance <= radius).tolist()


def test_license_places_and_notices(spark, docs, empty):
    rows = [
        (1, "Released under the MIT License, under the mit license"),
        (2, "x " * 100 + "subject to terms of the Mozilla Public License v. 2.0 " + "y " * 100),
        (3, None), (4, "mit license"), (5, "CC BY-NC 4.0"),
    ]
    got = {r["key"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (2, 1, 5, "mit")
    assert (got[2]["base_labels"], got[2]["labels"], got[2]["n_words"]) == ("", "mpl-2", 211)
    assert (got[3]["n_words"], got[3]["first_word"], got[3]["score"]) == (0, None, 0.0)
    assert got[4]["labels"] == "" and got[5]["base_labels"] == "cc-by-nc"
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_long_notices_are_found_wherever_they_stand(spark):
    notice = " ".join(f"w{i}" for i in range(150))
    rows = [(i, "x " * i + notice + " y" * 90) for i in range(0, 300, 37)] + [(1000, notice), (1001, "x " * 400)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), notices=(("long", notice),)).collect()
    assert {r["key"]: (r["labels"], r["score"]) for r in found} == {k: ("long", 1.0) if k != 1001 else ("", 0.0) for k, _ in rows}


def test_classes_and_samples_are_limited_before_the_shuffle(spark, vectors):
    from pyspark.sql import functions as F

    from nimbora.llm.ngrams import bounded_sample
    from nimbora.llm.vectors import members, usable

    found = members(usable(vectors[1], "vec_id", "embedding"), 6)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in found.filter("rep = 7").collect()) == [7, 300, 301, 302, 303, 304]
    rows = spark.range(5000).selectExpr("id", "id % 2 as c")
    sample = bounded_sample(rows, 1200, "c", "id")
    assert "_salt" in sample._jdf.queryExecution().optimizedPlan().toString()
    want = {r["id"] for c in (0, 1) for r in rows.filter(f"c = {c}").orderBy(F.xxhash64("id"), "id").limit(1200).collect()}
    assert sample.columns == ["id", "c"] and {r["id"] for r in sample.collect()} == want


def test_personal_data(spark, docs, empty):
    text = "mail a.b@c.example.com. call +1 (377) 555-0271 ip 10.1.2.3 999.1.2.3 card 4111 1111 1111 1111!"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["key"]: r for r in personal_data.find(rows, personal_data.train(rows)).collect()}
    assert [got[1][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    assert got[2]["spans"] == got[3]["spans"] == ""
    base = personal_data.base_spans(text)
    assert personal_data.redacted(text, base) == "mail <EMAIL>. call <PHONE> ip <IP> 999.1.2.3 card <CARD>!"
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for odd in ("a@b.com_x@d.org", "@@a@b.c@d.e", "a@b a@b.", "x@y.z.@q.r", "é@b.c a@-.-"):
        assert personal_data.addresses(odd) == [m.span() for m in pattern.finditer(odd)], odd
    model = personal_data.train(empty)
    assert personal_data.find(docs, model).count() == docs.count() and personal_data.find(empty, model).count() == 0


def test_toxicity_learns_marked_words(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, 30) + (" idiot fools" if i % 3 == 0 else "")) for i in range(150)]
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    scored = toxicity.with_score(docs, toxicity.train(docs, labels), column="s").collect()
    assert all((r["s"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in scored if r["doc_id"] < 900)
    assert all(0 <= r["s"] < 0.5 for r in scored if r["doc_id"] >= 900)
    none = toxicity.train(docs, labels.filter("false"))
    assert toxicity.with_score(docs.filter("false"), none, column="s").count() == 0


def test_language_two_steps(spark):
    rng = np.random.default_rng(7)
    own = {"en": "the and with thing", "de": "der und mit schön", "fr": "le et avec été", "es": "el y con año"}
    rows = [
        (4 * i + j, " ".join(rng.choice(own[c].split(), 12)), c) for i in range(40) for j, c in enumerate(own)
    ] + [(900, None, "en"), (901, "12 34!", "en"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = language.with_language(docs, model).collect()
    assert all(r["lang_pred"] == (r["lang"] if r["doc_id"] < 900 else "und") and 0 <= r["score"] <= 1 for r in got)
    assert language.with_language(docs, language.train(docs.filter("false"))).filter("lang_pred = 'und'").count() == len(rows)


def test_best_segmentations_equal_enumeration(docs, empty, texts):
    path = P.path("piece_bpe_32k.model")
    model = pieces.PieceModel(path, 4)

    def every(word):
        ends = model.lattice(word)
        go = lambda j: [(a + s, p + b) for i, s, b in ends[j] for a, p in go(i)] if j else [(0.0, b"")]
        return sorted(go(len(word)), key=lambda x: -x[0])[:4]

    for text in ("the cat", "wörld 漢x", "aaab bb c", " x  y", "e😀"):
        found = model.n_best_of(text)
        assert np.allclose([s for s, _ in found], [s for s, _ in every(model.normal(text))])
        assert len({ids for _, ids in found}) == len(found)
    rows = pieces.encode(docs, path, 3, with_ids=True)
    decoded = pieces.decode(rows.select("key", "rank", "ids"), path).collect()
    whole = {k: model.decode(model.processor.encode(t or "")) for k, t in texts}
    assert all(r["text"] == whole[r["key"]] for r in decoded)
    assert pieces.encode(empty, path).count() == 0


def test_forward_pass_over_many_words(texts):
    """Best and second best of all words at once, against the backward search of each word."""
    rng = np.random.default_rng(5)
    own = pieces.PieceModel(P.path("piece_bpe_32k.model"), 2)
    scores = np.round(rng.uniform(-12, -2, own.processor.get_piece_size()) * 4) / 4  # many ties
    model = pieces.PieceModel(P.path("piece_bpe_32k.model"), 2, scores=scores)
    words = {w for _, t in texts for w in model.words(t or "")}
    words |= {pieces.MARK + "".join(rng.choice(list("abeinst漢é😀\n9▁"), n)) for n in range(1, 90)} | {"a", "▁", "x" * 300}
    words = sorted(words)
    for word, (score, ids, loss) in zip(words, model.best_of_many(words)):
        found = model.word(word)
        assert (score, ids) == found[0] and (score, ids, loss) == model.best(word), word
        assert loss == (found[0][0] - found[1][0] if len(found) > 1 else float("inf")), word
    assert model.best_of_many([]) == []
    # The memory starting anew within a text changes nothing.
    small = pieces.PieceModel(P.path("piece_bpe_32k.model"), 2, memo_words=3, scores=scores)
    assert all(small.n_best_of(t or "") == model.n_best_of(t or "") for _, t in texts)


def test_edges_and_parts_are_found_as_by_search(texts):
    model = pieces.PieceModel(str(P.path("piece_bpe_32k.model")), 4)
    assert len(model.crowded)  # hashes that several edges share
    rng = np.random.default_rng(5)
    asked = np.concatenate([model.edges, model.edges + 1, rng.integers(0, model.edges.max(), 5000)])
    at, ok = model._edges_of(asked)
    assert (ok == np.isin(asked, model.edges)).all() and (model.edges[at[ok]] == asked[ok]).all()
    m = pieces.MARK
    odd = ["", m, m + m, "a", "a" + m, m + "a" + m + m + "b", "a" + m + "\0b" + m + "c", "\0", m + "a\nb" + m + "c"]
    for normal in odd + [model.normal(t or "") for _, t in texts]:
        assert model.parts(normal) == pieces.WORD.findall(normal)


def test_first_segmentation_is_that_of_the_library(spark, texts):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = P.path("piece_bpe_32k.model")
    rows = texts + [(100, "library"), (101, "the library of the libraries " * 5), (102, " " * 1007), (103, "  a    b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scores = pieces.counted_scores(docs, path)
    own = pieces.PieceModel(path, 4).processor
    counts = np.bincount(sum((own.encode(t or "") for _, t in rows), []), minlength=len(scores))
    usual = [i for i in range(len(scores)) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i))]
    want = np.log((counts[usual] + 1) / (counts[usual].sum() + len(usual)))
    assert np.abs(scores[usual] - want).max() <= pieces.SCORE_STEP
    # The library's own unigram search over the same scores.
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        piece.score = scores[i]
    reference = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    value = lambda ids: sum(scores[i] for i in ids)
    got = {r["key"]: r for r in pieces.encode(docs, path, 1, with_ids=True).collect()}
    for key, text in rows:
        ids, expected = got[key]["ids"], reference.encode(text or "")
        if not any(own.is_byte(i) for i in ids):
            assert abs(value(ids) - value(expected)) < 1e-9 and abs(got[key]["score"] - value(ids)) < 1e-9, text
    assert got[100]["ids"] == own.encode("library") == reference.encode("library")


def test_query_decodes_every_segmentation(spark, texts, tmp_path):
    from nimbora.llm import queries

    rows = texts + [(100, "library"), (101, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.piece_segmentations(spark, str(tmp_path)).collect()
    assert {r["rank"] for r in got if r["doc_id"] == 100} == {1, 2, 3, 4}
    text = {k: t or "" for k, t in rows}
    assert all(r["same_text"] and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got if r["doc_id"] < 5)
    assert {r["doc_id"] for r in got} == set(text) and all(r["same_text"] for r in got)


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, 60) + (" idiot fools" if i % 4 == 0 else ""), "en", "s", 1) for i in range(80)]
    rows += [(80, rows[1][1], "en", "s", 1), (81, rows[2][1] + " end", "en", "s", 1), (82, "12 34", "en", "s", 1)]
    rows += [(83, prose(rng, 30) + " write to me@mail.example.com now", "en", "s", 1), (84, None, None, None, None)]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, fields).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, int(i % 4 == 0)) for i in range(80)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [f.split()[0] for f in fields.split(", ")]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i in range(80) if i % 4} | {80, 81, 82, 83, 84}
    assert set(kept["toxicity"]) == clean
    assert set(kept["language"]) == clean - {82, 84}
    assert set(kept["near_dedup"]) == clean - {80, 81, 82, 84}
    assert kept["personal_data"][83].endswith(" write to <EMAIL> now")
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(kept["personal_data"])
    docs.unpersist()
