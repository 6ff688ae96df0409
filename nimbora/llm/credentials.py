"""Secrets by linking the parts of credentials.

A credential has an access identifier, a secret and an endpoint. Patterns sure of themselves are
reported as they are. Weak candidates (an e-mail address, a short or unnamed key, a host) mean
nothing alone: they are reported only where an interval join finds a complementary part within
their scope, which is the paragraph, and in it what lies at most REACH code points away.
"""

import hashlib
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbora.llm.common import slices, write_scratch
from nimbora.llm.personal_data import addresses

#: Kinds of the base scan, in their order, then those of weak candidates. Fixed values, the first three.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "login", "email", "key", "endpoint")
SECRET, IDENTIFIER, ENDPOINT = "secret", "identifier", "endpoint"
ROLES = dict(zip(KINDS, (SECRET, IDENTIFIER, SECRET, IDENTIFIER, IDENTIFIER, SECRET, ENDPOINT)))
REACH = 240

#: Base patterns. Fixed values.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of hexadecimal digits shorter than the base asks for are passed over at once.
HEX = re.compile(r"[0-9a-f]{24,}")
NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Weak candidates; the span is the value, not its name.
SETS = r"""["']?\x20{0,8}[:=]\x20{0,8}["']?"""
LOGIN = re.compile(rf"\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?){SETS}([\w.+@/=-]{{3,}})", re.I | re.A)
KEY = re.compile(
    rf"\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|auth|bearer|credentials?|(?:\w{{1,20}}_)?key){SETS}([\w.+/=!#$%&*-]{{4,}})",
    re.I | re.A,
)
HOST = re.compile(rf"\b(?:host(?:name)?|server|endpoint|url|uri){SETS}([\w.:/-]{{3,}})", re.I | re.A)
URL = re.compile(
    r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://(?:([^\s:/@\"'<>]{1,64}):([^\s:/@\"'<>]{1,256})@)?([^\s\"'<>@]{3,})"
)
ADDRESS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9])")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
#: An unnamed key has letters, digits and at least so many different characters.
MIXED_LETTERS = 9
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), leftmost and not overlapping within a kind."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    lower = text.lower()
    if any(name in lower for name in NAMED):
        found += [
            (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
        ]
    return sorted(found)


def _unnamed_key(value: str) -> bool:
    some_digit = any("0" <= c <= "9" for c in value)
    return some_digit and any(c.isalpha() for c in value) and len(set(value)) >= MIXED_LETTERS


def weak_spans(text: str, base) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak candidates, none touching a base span or an earlier one. Without
    an identifier or an endpoint in the text, or without a secret, there are none."""
    found: list[tuple[int, int, int]] = []
    urls = list(URL.finditer(text)) if "://" in text else []
    for m in urls:
        found += [(m.start(g), kind, m.end(g)) for g, kind in ((1, 3), (2, 5)) if m[g]]
        found.append((m.start(3) if m[1] else m.start(), 6, m.end()))
    if ":" in text or "=" in text:
        found += [(m.start(1), 3, m.end(1)) for m in LOGIN.finditer(text)]
        found += [(m.start(1), 6, m.end(1)) for m in HOST.finditer(text)]
    if "@" in text:
        ends = [0, *(m.end() for m in urls)]
        begins = [m.start() for m in urls]
        found += [(s, 4, e) for s, e in addresses(text) if ends[bisect_right(begins, s)] <= s]
    if "." in text:
        found += [(m.start(), 6, m.end()) for m in ADDRESS.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 3, m.end()) for m in ACCESS.finditer(text)]
    if not found and not any(k == 1 for _, k, _ in base):
        return []
    if ":" in text or "=" in text:
        found += [(m.start(1), 5, m.end(1)) for m in KEY.finditer(text)]
    found += [(m.start(), 5, m.end()) for m in MIXED.finditer(text) if _unnamed_key(m[0])]
    kept: list[tuple[int, int, int]] = []
    taken = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in taken]
    reach = [0]
    for _, e in taken:
        reach.append(max(reach[-1], e))
    free = 0
    for start, kind, end in sorted(found, key=lambda f: (f[0], -f[2], f[1])):
        if start >= free and reach[bisect_right(starts, end - 1)] <= start:
            kept.append((start, kind, end))
            free = end
    return kept


PART = "struct<start:bigint,kind:int,end:bigint>"
FOUND = f"key_id string, base array<{PART}>, parts array<struct<start:bigint,kind:int,end:bigint,paragraph:bigint>>"


def _parts(text: str, base) -> list[dict]:
    """Base and weak spans with their paragraphs, if they hold a secret and something to link to."""
    weak = weak_spans(text, base)
    roles = {ROLES[KINDS[k]] for _, k, _ in base + weak}
    if not weak or SECRET not in roles or len(roles) < 2:
        return []
    breaks = [m.start() for m in PARAGRAPH.finditer(text)]
    return [
        {"start": s, "kind": k, "end": e, "paragraph": bisect_right(breaks, s)} for s, k, e in sorted(base + weak)
    ]


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """(key_id, start, kind, end) of the weak parts with a complementary part in scope.

    An interval join by bands of `reach` code points: a part lies in every band it covers, a secret
    also looks into the bands before and behind. A band holds few parts, as parts of a kind don't
    overlap, so the pairs grow with the text, and a long document is many bands.
    """
    band = lambda place: F.floor(place / reach)
    secret = F.col("kind").isin([k for k, name in enumerate(KINDS) if ROLES[name] == SECRET])
    covers = F.explode(F.sequence(band(F.col("start")), band(F.col("end") - 1))).alias("band")
    looks = F.explode(F.sequence(band(F.col("start")) - 1, band(F.col("end") - 1) + 1)).alias("band")
    scope = ["key_id", "paragraph"]
    left = parts.filter(secret).select(*scope, "start", "kind", "end", looks).alias("s")
    right = parts.filter(~secret).select(*scope, "start", "kind", "end", covers).alias("o")
    gap = F.greatest(F.col("o.start") - F.col("s.end"), F.col("s.start") - F.col("o.end"))
    same = [F.col(f"s.{c}") == F.col(f"o.{c}") for c in (*scope, "band")]
    met = left.join(right, [*same, gap <= reach])
    ends = F.array(*(F.struct(f"{side}.start", f"{side}.kind", f"{side}.end") for side in "so"))
    both = met.select(F.col("s.key_id").alias("key_id"), F.inline(ends))
    return both.filter(F.col("kind") >= len(BASE_KINDS)).distinct()


def linked_credentials(
    docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH
) -> DataFrame:
    """One row per input row: key, base, spans, each an array of (start, kind, end) by start, then
    kind in the order of KINDS.

    `base` holds what the base patterns find; `spans` holds these and the weak candidates that have
    a complementary part (a secret for an identifier or endpoint, one of these for a secret) in the
    same paragraph and at most `reach` code points away. Offsets are code points, ends exclusive.

    A null or empty text has no spans. Rows are told apart by a digest of key and text, so repeated
    rows, or a key with several texts, are answered each for itself; a null key is kept; very long
    texts are searched whole; ties need no order, as spans are sorted; an empty table gives no rows.
    Other columns are not read, so their names are free.
    """
    import pyarrow as pa

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    named = T.StructType([T.StructField("key", rows.schema["key"].dataType)])
    schema = T.StructType(named.fields + T._parse_datatype_string(FOUND).fields)
    span = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]

    def extract(batches):
        for batch in slices(batches):
            ids, bases, parts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_spans(t or "")
                own = _parts(t, base) if t else []
                name = repr(k).encode() + b"\0" + (t or "").encode()
                ids.append(hashlib.blake2b(name, digest_size=16).hexdigest() if own else None)
                bases.append([{"start": s, "kind": i, "end": e} for s, i, e in base])
                parts.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ids, pa.string()),
                    pa.array(bases, pa.list_(pa.struct(span))),
                    pa.array(parts, pa.list_(pa.struct([*span, ("paragraph", pa.int64())]))),
                ],
                schema.names,
            )

    found, _ = write_scratch(rows.mapInArrow(extract, schema), "credential-parts")
    linkable = found.filter("key_id is not null")
    linked = _linked(linkable.select("key_id", F.inline("parts")).distinct(), reach)
    added = linked.groupBy("key_id").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    none = F.array().cast(f"array<{PART}>")
    joined = linkable.join(added, "key_id", "left").select("key", "base", F.coalesce("added", none).alias("added"))
    alone = found.filter("key_id is null").select("key", "base", none.alias("added"))
    every = F.array_sort(F.concat("base", "added"))
    named_kind = lambda spans: F.transform(
        spans,
        lambda p: F.struct(
            p["start"], F.element_at(F.array(*map(F.lit, KINDS)), p["kind"] + 1).alias("kind"), p["end"]
        ),
    )
    return alone.unionByName(joined).select(
        "key", named_kind(F.col("base")).alias("base"), named_kind(every).alias("spans")
    )
