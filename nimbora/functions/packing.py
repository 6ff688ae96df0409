"""Many texts in one, for rows that travel: a text of a row costs 16 bytes and more besides itself."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK, _BETWEEN = "\x1b", "\x1f"
_ESCAPED = ((_MARK, _MARK + "e"), (_BETWEEN, _MARK + "s"))
_NULL = _MARK + "n"


def pack_texts(columns: Sequence[str]) -> Column:
    """One text that holds the given texts, NULLs and blanks told apart."""

    def escaped(text: Column) -> Column:
        for plain, written in _ESCAPED:
            text = F.replace(text, F.lit(plain), F.lit(written))
        return F.coalesce(text, F.lit(_NULL))

    return F.concat_ws(_BETWEEN, *[escaped(F.col(c)) for c in columns])


def unpack_texts(parts: Column, columns: Sequence[str]) -> list[Column]:
    """The texts again, from `split_texts` of the packed one."""

    def plain(text: Column) -> Column:
        value = text
        for original, written in reversed(_ESCAPED):
            value = F.replace(value, F.lit(written), F.lit(original))
        return F.when(text != _NULL, value)

    return [plain(parts[i]).alias(c) for i, c in enumerate(columns)]


def split_texts(packed: Column) -> Column:
    return F.split(packed, _BETWEEN, -1)
