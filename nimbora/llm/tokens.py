"""Encoding of many texts with a public tokenizer, word by word.

A byte-pair model never merges across the pieces that its pre-tokenizer cuts, and both
supported cuts fall at a single space between two characters that are not white space.
So a text is encoded by its space-separated chunks, and a chunk seen before on this worker
is looked up. A new chunk of plain letters, digits and signs is cut as the pre-tokenizer cuts it,
and its words, looked up as well, go to the library's model directly; any other new chunk goes
through the whole library. The ids equal those of encoding the text at once; a test compares them.
A text that may name a special token is encoded at once by the library itself.
"""

import re
import sys
from array import array

import numpy as np

from nimbora.llm.common import worker_cache

#: Chunks in each of a worker's two generations of memory: when the newer one is full it becomes the
#: older, and what is asked for again moves back, so that frequent chunks stay. Longer chunks are
#: not kept. Words of chunks are remembered likewise.
MEMO_CHUNKS, MEMO_LENGTH, MEMO_WORDS = 400_000, 64, 200_000

#: Letters of plain chunks: ASCII and Latin-1, which no normal form changes and which have one lower case.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


class Memory(dict):
    """A value for each key asked for, worked out once by `made`. It holds two generations: itself,
    and the one before."""

    def __init__(self, room: int, made):
        super().__init__()
        self.room, self.made = room, made
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class ChunkEncoder:
    """Texts to little-endian id bytes, two bytes an id where the vocabulary allows it."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.code = "H" if self.dtype == "<u2" else "I"
        self.drops_space = self.tokenizer.normalizer is not None
        self.words = Memory(memo_words, self._word)
        self.memo = Memory(memo_chunks, self._chunk)
        # The model knows characters by their bytes, each written as one printable character.
        spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        known = ["\n", *map(chr, range(0x20, 0x7F)), *map(chr, range(0xC0, 0x100))]
        self.spelling = {ord(c): spelled(c)[0][0] for c in known}
        if self.drops_space:
            self.plain = re.compile(f"[!-~{LETTERS}]*").fullmatch
            self.cut = re.compile(f"{ENDINGS}|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+").findall
        else:
            self.plain = re.compile(f"[\n -~{LETTERS}]*").fullmatch
            kinds = f" ?[{LETTERS}]+| ?[0-9]+| ?[^ \n{LETTERS}0-9]+"
            self.cut = re.compile(rf"{ENDINGS}|{kinds}|[ \n]+(?![^ \n])|[ \n]+").findall
        self.runs, self.beside = re.compile(r"\s\s"), re.compile(r" \s|\s ")
        self.between = re.compile(r"(?<=\S) (?=\S)")
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names)) or r"(?!)", re.IGNORECASE)
        self.hints = {n[0] for n in names} | {n[0].swapcase() for n in names}

    def chunks(self, text: str) -> list[str]:
        """Names of the pieces whose ids, put together, are the ids of the text. Where spaces count,
        every piece but the first begins with one: it is left out, and put before the first."""
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        spaces_run = self.runs.search(text) and self.beside.search(text)
        parts = self.between.split(text) if spaces_run else text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.memo.__getitem__
        return [
            self._library(t)
            if any(h in t for h in self.hints) and self.special.search(t)
            else b"".join(map(found, self.chunks(t)))
            for t in texts
        ]

    def _library(self, text: str) -> bytes:
        return id_bytes(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        # Of plain ASCII only spaces and line ends are written otherwise.
        if word.isascii() and "\n" not in word:
            spelled = word.replace(" ", self.spelling[0x20])
        else:
            spelled = word.translate(self.spelling)
        return id_bytes(self.code, [t.id for t in self.model.tokenize(spelled)])

    def _chunk(self, name: str) -> bytes:
        if self.drops_space:
            chunk = name
        else:
            chunk = name[1:] if name.startswith(" ") else " " + name
        if not self.plain(chunk):
            return self._library(chunk)
        return b"".join(map(self.words.__getitem__, self.cut(chunk.lower() if self.drops_space else chunk)))


def id_bytes(code: str, ids: list[int]) -> bytes:
    """Little-endian bytes of ids of this array type."""
    values = array(code, ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def id_type(vocabulary: int) -> str:
    """Narrowest little-endian type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for this vocabulary file; one is kept at a time."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache("tokens")
    if cache.get("encoder_path") != path:
        cache["encoder"], cache["encoder_path"] = ChunkEncoder(path), path
    return cache["encoder"]
