"""SentencePiece encoding and decoding with N-best segmentation.

Pieces never hold the space mark after another character, so the lattice of a text falls apart
into that of its words. In a word, forward Viterbi scores are the exact heuristic of a backward
A* search, which gives its segmentations best first. The best of a text are combinations of those
of its words; only the words with the smallest loss of second place can differ from their best.
The forward pass knows that loss, so only those words are searched backward.

The scores of a BPE model are merge ranks and do not add up to those of a text. For such a model a
piece scores the logarithm of its share in the model's own encoding of all texts.
"""

import heapq
import re
import zlib
from collections import Counter
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import slices, worker_cache

MARK = "▁"
#: Words remembered per worker; beyond it the memory starts anew.
MEMO_WORDS = 700_000
#: Words searched backward that a worker remembers, likewise.
MEMO_SEARCHED = 50_000
#: Distinct words segmented at once, and code points of texts whose words are sought together.
WORDS_AT_ONCE, TEXT_AT_ONCE = 50_000, 2_000_000
#: Words of more code points are segmented one by one.
LONG_WORD = 64
#: A code point fits into so many bits.
CHARACTER_BITS = 21
#: Edges of the tree of pieces are hashed to so many bits.
SLOT_BITS, ODD = 20, np.uint64(0x9E3779B97F4A7C15)
#: Added to the lowest score of the vocabulary for a character without a piece. Fixed value.
UNKNOWN_PENALTY = 10.0
#: Counted scores are multiples of this, so that their sums are exact and equal scores tie.
SCORE_STEP = 2.0**-16
CUT = "\0"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceModel:
    """A SentencePiece model file's pieces and scores, and segmentation over them."""

    def __init__(self, path: str, n_best: int, memo_words: int = MEMO_WORDS, scores: np.ndarray | None = None):
        import sentencepiece

        model = self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best, self.memo_words = n_best, memo_words
        self.scores: dict[str, tuple[float, bytes]] = {}
        self.bytes = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores[model.id_to_piece(i)] = (model.get_score(i) if scores is None else float(scores[i]), i.to_bytes(4, "little"))
        # Every piece and, with None, every other beginning of one.
        self.begins = {p[:n]: None for p in self.scores for n in range(1, len(p) + 1)} | self.scores
        usual = [s for s, _ in self.scores.values() if s > -1e8]
        self.unknown = min(usual, default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        self._trie()
        self.mark_cuts = not any(MARK in p.lstrip(MARK) for p in self.scores)
        self.mark_first = model.normalize("a").startswith(MARK)
        self.memo: dict[str, tuple] = {}
        self.searched: dict[str, tuple] = {}
        self.decoded_parts: dict[bytes, str] = {}

    def _trie(self):
        """The beginnings of pieces as arrays: an edge is its node's number and a character. ASCII
        characters without a piece are pieces at the unknown score here, as they have one id."""
        alone = [c for c in map(chr, range(128)) if not self.begins.get(c)]
        begins = self.begins | {c: (self.unknown, self._fallback(c)) for c in alone}
        number = {"": 0} | {p: i for i, p in enumerate(begins, 1)}
        edges = np.array([number[p[:-1]] << CHARACTER_BITS | ord(p[-1]) for p in begins], np.int64)
        order = np.argsort(edges)
        self.edges, self.below = edges[order], 1 + order
        # An edge is found at its hash; of several at one, all but the last are in a sorted list.
        at = np.arange(len(edges), dtype=np.int32)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[self._slot(self.edges)] = at
        self.crowded = at[self.slots[self._slot(self.edges)] != at]
        self.crowded_edges = self.edges[self.crowded]
        self.score_at = np.array([float("nan")] + [v[0] if v else float("nan") for v in begins.values()])
        self.id_at = np.array([0] + [int.from_bytes(v[1], "little") if v else 0 for v in begins.values()], "<u4")

    @staticmethod
    def _slot(edges: np.ndarray) -> np.ndarray:
        return (edges.astype(np.uint64) * ODD) >> np.uint64(64 - SLOT_BITS)

    def _edges_of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of these edges, and whether there is such an edge."""
        at = self.slots[self._slot(asked)]
        ok = self.edges[at] == asked
        missed = np.flatnonzero(~ok)
        if len(missed) and len(self.crowded):
            sought = asked[missed]
            place = np.minimum(np.searchsorted(self.crowded_edges, sought), len(self.crowded) - 1)
            ok[missed] = self.crowded_edges[place] == sought
            at[missed] = self.crowded[place]
        return at, ok

    def normal(self, text: str) -> str:
        """The library's own normal form of the text, spaces as marks."""
        return self.processor.normalize(text) if text else ""

    def words(self, text: str) -> list[str]:
        """The parts of the normal text that are segmented apart."""
        return self.parts(self.normal(text))

    def parts(self, normal: str) -> list[str]:
        if not self.mark_cuts:
            return [normal] if normal else []
        if MARK + MARK in normal or CUT in normal:
            return WORD.findall(normal)
        # Without marks in a row a word begins at each of them.
        words = normal.replace(MARK, CUT + MARK).split(CUT)
        return words if words[0] else words[1:]

    def own_ids(self, words: list[str]) -> list[list[int]]:
        """The library's own encoding of parts of normal texts."""
        found = self.processor.encode([self.plain(w) for w in words], num_threads=1)
        # Nothing is put before an empty text.
        return [ids or [self.processor.piece_to_id(w)] for w, ids in zip(words, found)]

    def ranked(self) -> bool:
        """Whether the model's scores are merge ranks, which are whole numbers."""
        return all(s == int(s) for s, _ in self.scores.values())

    def _fallback(self, char: str) -> bytes:
        raw = char.encode("utf-8", "surrogatepass")
        ids = [self.bytes[b] for b in raw] if self.bytes else [self.unknown_id]
        return np.array(ids, "<u4").tobytes()

    def lattice(self, word: str):
        """By end position: (start, score, id bytes) of each piece. A character that no piece of
        its own covers has its bytes, at the unknown score."""
        get, n = self.begins.get, len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                found = get(word[i:j], 0)
                if found:
                    ends[j].append((i, *found))
                    single = single or j == i + 1
                elif found == 0:
                    break
            if not single:
                ends[i + 1].append((i, self.unknown, self._fallback(word[i])))
        return ends

    def word(self, word: str) -> tuple:
        """Up to n_best (score, id bytes) of a word, best first; ties in a fixed order, longer
        last pieces first, which keeps many equal segmentations from being searched side by side."""
        ends, n = self.lattice(word), len(word)
        forward = [0.0] + [0.0] * n
        for j in range(1, n + 1):
            forward[j] = max([forward[i] + s for i, s, _ in ends[j]])
        # Backward from the end: what is done, plus the best score from the start to here.
        heap, found = [(-forward[n], n, b"", 0.0)], []
        while heap and len(found) < self.n_best:
            _, at, ids, done = heapq.heappop(heap)
            if at == 0:
                found.append((done, ids))
                continue
            for i, s, piece in ends[at]:
                heapq.heappush(heap, (-(done + s + forward[i]), i, piece + ids, done + s))
        return tuple(found)

    def best(self, word: str) -> tuple[float, bytes, float]:
        """Score and id bytes of the best segmentation of a word, the one that `word` finds first,
        and what the second best loses against it: infinite where there is none."""
        get, n, none = self.begins.get, len(word), float("-inf")
        first, second, last = [0.0] + [none] * n, [none] * (n + 1), [None] * (n + 1)
        for i in range(n):
            one, two, single = first[i], second[i], False
            for j in range(i + 1, n + 1):
                found = get(word[i:j], 0)
                if found:
                    s, piece = found
                    if j == i + 1:
                        single = True
                elif found == 0:
                    break
                else:
                    continue
                now, s = first[j], s + one
                # Of equal scores the one with the longer last piece came first and stays.
                if s > now:
                    other = two + s - one
                    first[j], second[j], last[j] = s, now if now > other else other, (i, piece)
                elif s > second[j]:
                    second[j] = s
            if not single:
                j, s = i + 1, one + self.unknown
                now = first[j]
                if s > now:
                    other = two + self.unknown
                    first[j], second[j], last[j] = s, now if now > other else other, (i, self._fallback(word[i]))
                elif s > second[j]:
                    second[j] = s
        ids, at = [], n
        while at:
            at, piece = last[at]
            ids.append(piece)
        return first[n], b"".join(ids[::-1]), first[n] - second[n]

    def best_of_many(self, words: list[str]) -> list[tuple[float, bytes, float]]:
        """`best` of each word, a step of the forward pass taken for all of them at once. Words with
        another character that is no piece, and long ones, are left to `best`."""
        length = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        text = np.cumsum(length) - length
        base = text + np.arange(len(words))  # a word has one position more than letters
        size, hard = len(letters) + len(words), length > LONG_WORD
        first, second = np.full(size, -np.inf), np.full(size, -np.inf)
        last, width = np.zeros(size, np.int64), np.zeros(size, np.int64)
        first[base] = 0.0
        rows = np.flatnonzero(~hard)
        for i in range(int(length[rows].max(initial=0))):
            rows = rows[(length[rows] > i) & ~hard[rows]]
            live, node, n = rows, np.zeros(len(rows), np.int64), 0
            while len(live):
                asked = node << CHARACTER_BITS | letters[text[live] + i + n]
                at, ok = self._edges_of(asked)
                live, node, n = live[ok], self.below[at[ok]], n + 1
                score = self.score_at[node]
                piece = score == score
                if n == 1:
                    hard[rows] = True
                    hard[live[piece]] = False
                begin = base[live[piece]] + i
                j, gain = begin + n, score[piece]
                s, now = first[begin] + gain, first[j]
                # Of equal scores the one with the longer last piece came first and stays.
                up = s > now
                second[j] = np.where(up, np.maximum(now, second[begin] + gain), np.maximum(second[j], s))
                j = j[up]
                first[j], last[j], width[j] = s[up], node[piece][up], n
                more = length[live] > i + n
                live, node = live[more], node[more]
        easy = np.flatnonzero(~hard)
        at, steps = (base + length)[easy], []
        rows = np.arange(len(easy))
        while len(rows):
            steps.append((rows, last[at]))
            at = at - width[at]
            more = at > base[easy[rows]]
            rows, at = rows[more], at[more]
        count = np.zeros(len(easy), np.int64)
        for rows, _ in steps:
            count[rows] += 1
        ends = np.cumsum(count)
        ids = np.zeros(int(count.sum()), "<u4")
        for back, (rows, node) in enumerate(steps, 1):
            ids[ends[rows] - back] = self.id_at[node]
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        top = first[(base + length)[easy]]
        lost = (top - second[(base + length)[easy]]).tolist()
        out: list = [None] * len(words)
        start = 0
        for i, score, end, loss in zip(easy.tolist(), top.tolist(), ends, lost):
            out[i] = (score, raw[start:end], loss)
            start = end
        for i in np.flatnonzero(hard).tolist():
            out[i] = self.best(words[i])
        return out

    def remember(self, words: set[str]):
        """Have the best segmentations of these words at hand."""
        if len(self.memo) > self.memo_words:
            self.memo.clear()
        new = list(words.difference(self.memo))
        for start in range(0, len(new), WORDS_AT_ONCE):
            some = new[start : start + WORDS_AT_ONCE]
            self.memo.update(zip(some, self.best_of_many(some)))

    def options(self, word: str) -> tuple:
        found = self.searched.get(word)
        if found is None:
            if len(self.searched) > MEMO_SEARCHED:
                self.searched.clear()
            found = self.searched[word] = self.word(word)
        return found

    def n_best_of(self, text: str) -> list[tuple[float, bytes]]:
        """Up to n_best (score, little-endian 32-bit ids) of a whole text, best first."""
        return [(score, ids) for score, ids, _ in self.n_best_parts(self.words(text))]

    def n_best_parts(self, words: list[str]) -> list[tuple[float, bytes, list]]:
        """As `n_best_of` for the parts of a text, with (best ids, ids here) of the changed parts."""
        if not words:
            return [(0.0, b"", [])]
        try:
            found = [*map(self.memo.__getitem__, words)]
        except KeyError:
            self.remember(set(words))
            found = [*map(self.memo.__getitem__, words)]
        scores, ids, losses = zip(*found)
        best, score = b"".join(ids), float(sum(scores))
        # A text that changes a word of larger loss is worse than n_best - 1 single changes.
        places, losses = [], list(losses)
        for _ in range(min(self.n_best - 1, len(words))):
            if (least := min(losses)) == float("inf"):
                break
            places.append(i := losses.index(least))
            losses[i] = float("inf")
        if not places:
            return [(score, best, [])]
        ends = list(accumulate(map(len, ids)))
        options = [self.options(words[i]) for i in places]
        return [(total, *self._ids(best, ends, places, options, choice)) for total, choice in self._combined(options, score)]

    def _combined(self, options, score):
        """(score, option taken for each of the words), best first."""
        start = (0,) * len(options)
        heap, seen, out = [(-score, start)], {start}, []
        while heap and len(out) < self.n_best:
            total, choice = heapq.heappop(heap)
            out.append((-total, choice))
            for p, c in enumerate(choice):
                if c + 1 < len(options[p]) and (next_ := choice[:p] + (c + 1,) + choice[p + 1 :]) not in seen:
                    seen.add(next_)
                    lost = options[p][c][0] - options[p][c + 1][0]
                    heapq.heappush(heap, (total + lost, next_))
        return out

    @staticmethod
    def _ids(best, ends, places, options, choice):
        """Ids of the text with the chosen options, and (best ids, ids here) of the changed words."""
        parts, changes, at = [], [], 0
        for i, found, c in sorted(zip(places, options, choice)):
            if c:
                start = ends[i - 1] if i else 0
                parts += [best[at:start], found[c][1]]
                changes.append((found[0][1], found[c][1]))
                at = ends[i]
        return b"".join([*parts, best[at:]]), changes

    def plain(self, normal: str) -> str:
        """A normal text with spaces for marks, without the one put before it."""
        return normal[self.mark_first and normal.startswith(MARK) :].replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)

    def decode_bytes(self, ids: bytes) -> str:
        return self.decode(np.frombuffer(ids, "<i4").tolist())

    def same_decoded(self, changes: list[tuple[bytes, bytes]]) -> bool:
        """Whether each changed word decodes as before; so does the text then, piece by piece."""
        return all(self._decoded_part(a) == self._decoded_part(b) for a, b in changes)

    def _decoded_part(self, ids: bytes) -> str:
        found = self.decoded_parts.get(ids)
        if found is None:
            if len(self.decoded_parts) > MEMO_SEARCHED:
                self.decoded_parts.clear()
            found = self.decoded_parts[ids] = self.decode_bytes(ids)
        return found


def piece_model(path: str, n_best: int, scores: np.ndarray | None = None) -> PieceModel:
    cache, asked = worker_cache("pieces"), (path, n_best, None if scores is None else scores.tobytes())
    if cache.get("pieces_of") != asked:
        cache["pieces"], cache["pieces_of"] = PieceModel(path, n_best, scores=scores), asked
    return cache["pieces"]


def counted_scores(docs: DataFrame, model_path: str, text: str = "text") -> np.ndarray | None:
    """Log-probability of each piece of a BPE model: its share, one added to each count, in the
    model's own encoding of all texts. None for a model that has log-probabilities."""
    import pyarrow as pa

    local = PieceModel(model_path, 1)
    if not local.ranked():
        return None

    def counted(batches):
        model, seen = piece_model(model_path, 1), Counter()
        sums = np.zeros(model.processor.get_piece_size(), dtype=np.int64)

        def flush():
            words = list(seen)
            for start in range(0, len(words), WORDS_AT_ONCE):
                some = words[start : start + WORDS_AT_ONCE]
                found = model.own_ids(some)
                times = np.repeat([seen[w] for w in some], [len(ids) for ids in found])
                np.add.at(sums, np.fromiter(chain.from_iterable(found), np.int64, len(times)), times)
            seen.clear()

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                seen.update(model.words(t or ""))
            if len(seen) > MEMO_WORDS:
                flush()
        flush()
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], ["id", "n"])

    found = docs.select(F.col(text).alias("t")).mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(local.processor.get_piece_size())
    for r in found.collect():  # a row for each piece of the vocabulary at most
        counts[r["id"]] = r["n"]
    used = [int.from_bytes(i, "little") for _, i in local.scores.values()]
    scores = np.zeros(len(counts))
    scores[used] = np.log((counts[used] + 1) / (counts[used].sum() + len(used)))
    return np.round(scores / SCORE_STEP) * SCORE_STEP


def encode(
    docs: DataFrame, model_path: str, n_best: int = 4, key: str = "doc_id", text: str = "text", with_ids: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """One row per document and segmentation: key, rank (from 1), n_pieces, score, ids_crc32, and
    `ids` where asked for. With `decoded`, also text_crc32 of the text decoded from the ids and
    whether it is the normal text.

    Texts with fewer segmentations have fewer ranks. A null or empty text has one, without
    pieces, at score 0. Equal scores come in a fixed order; repeated rows are answered each for
    itself; texts are segmented whole; an empty table gives no rows. Other columns are not read.
    Texts are read twice where pieces have to be counted.
    """
    import pyarrow as pa

    scores = counted_scores(docs, model_path, text)
    names = ["key", "rank", "n_pieces", "score", "ids_crc32"] + ["ids"] * with_ids + ["text_crc32", "same_text"] * decoded
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
    kinds += [pa.list_(pa.int32())] * with_ids + [pa.int64(), pa.bool_()] * decoded

    def prepared(model, batch):
        """(key, normal text, words) of each row; the words of many texts are segmented at once."""
        held, size = [], 0

        def ready():
            model.remember(set(chain.from_iterable(words for _, _, words in held)))
            return held

        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            normal = model.normal(t or "")
            held.append((k, normal, model.parts(normal)))
            size += len(normal)
            if size > TEXT_AT_ONCE:
                yield from ready()
                held, size = [], 0
        yield from ready()

    def encoded(batches):
        model = piece_model(model_path, n_best, scores)
        for batch in slices(batches):
            out = [[] for _ in names]
            for k, normal, words in prepared(model, batch):
                first = None
                for rank, (score, ids, changes) in enumerate(model.n_best_parts(words), 1):
                    row = [k, rank, len(ids) // 4, score, zlib.crc32(ids)]
                    row += [np.frombuffer(ids, "<i4")] * with_ids
                    if decoded:
                        if first is None or not model.same_decoded(changes):
                            back = model.decode_bytes(ids)
                            text_of = [zlib.crc32(back.encode("utf-8", "surrogatepass")), back == model.plain(normal)]
                            first = first or text_of
                        else:
                            text_of = first
                        row += text_of
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    fields = "key long, rank int, n_pieces long, score double, ids_crc32 long"
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    fields += ", ids array<int>" * with_ids + ", text_crc32 long, same_text boolean" * decoded
    return rows.mapInArrow(encoded, fields)


def decode(rows: DataFrame, model_path: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """All columns of `rows` and the text of its ids (null ids: null)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    at = rows.columns.index(ids)

    def decoded(batches):
        model = piece_model(model_path, 1)
        for batch in slices(batches):
            texts = [None if i is None else model.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])

    return rows.mapInArrow(decoded, T.StructType([*rows.schema.fields, T.StructField(column, T.StringType())]))
