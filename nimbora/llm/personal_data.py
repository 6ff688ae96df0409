"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation estimates
how reliable each is, and a span classifier is trained on the resulting chances."""

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbora.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
ABSTAIN = "-"

#: Base patterns. Fixed values. The address pattern is matched around each @, and a number with
#: dots only from the start of its digits: the same matches, in time linear in the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGIT = re.compile(r"[0-9]")
WRITTEN_AT = re.compile(r"(?i)\bat\b[)\]\s]")

#: Wider candidates: numbers with separators, and addresses with a spelled-out at or dot.
NUMBER = re.compile(r"(?:\+|\()?[0-9](?:[ ().-]{0,2}[0-9]){5,22}")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[(\[] ?at ?[)\]]| at ) ?[A-Za-z0-9-]+"
    r"(?: ?(?:\.|[(\[] ?dot ?[)\]]| dot ) ?[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)

#: Words that stand before a kind of data; top-level names; first digits of card issuers.
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|correo|contact|kontakt|write to|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address from|client|login from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|whatsapp)\b"),
}
TOP_NAMES = frozenset("com org net edu gov io info biz de fr es it uk eu us ca au jp cn in br ru nl ch at".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35")
CUE_REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _accepted(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in match.split(".")))
    if kind == "card":
        return 12 <= len(d := _digits(match)) <= 19 and luhn(d)
    return 9 <= len(_digits(match)) <= 15


def addresses(text: str) -> list[tuple[int, int]]:
    """(start, end) of e-mail addresses, leftmost and not overlapping."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and not overlapping within a kind."""
    kinds = [1, 2] + [3] * ("+" in text) if DIGIT.search(text) else []
    found = [(s, 0, e) for s, e in addresses(text)]
    found += [
        (m.start(), k, m.end())
        for k in kinds
        for m in PATTERNS[KINDS[k]].finditer(text)
        if _accepted(KINDS[k], m[0])
    ]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of spans that the labelers look at."""
    found = [m.span() for m in NUMBER.finditer(text)] if DIGIT.search(text) else []
    if "@" in text or WRITTEN_AT.search(text):
        found += [m.span() for m in SPELLED.finditer(text)]
    return sorted(found)


def describe(text: str, start: int, end: int, base) -> tuple[str, str]:
    """(features, votes) of a span: a short text of span and context classes, and one letter
    for each labeler: the kind's place, 4 for no personal data, - for no opinion."""
    span = text[start:end]
    digits, before = _digits(span), text[max(0, start - CUE_REACH) : start]
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[:6]) <= 255 for p in parts)
    address = "@" in span or not span[0].isdigit() and span[0] not in "+("
    touches = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    cue = next((i for i, k in enumerate(KINDS) if CUES[k].search(before)), None)
    overlapping = next((k for s, k, e in base if s < end and start < e), None)

    pattern = ABSTAIN if overlapping is None else str(overlapping)
    if address:
        tail = re.split(r"[^A-Za-z]+", span)[-1].lower()
        gazetteer = "0" if tail in TOP_NAMES else str(NONE)
    elif 13 <= len(digits) <= 19:
        gazetteer = "2" if ISSUERS.match(digits) else str(NONE)
    else:
        gazetteer = "3" if span[0] == "+" else ABSTAIN
    context = ABSTAIN if cue is None else str(cue)
    if address:
        form = "0" if "@" in span else ABSTAIN
    elif octets:
        form = "1"
    elif len(digits) >= 12 and luhn(digits):
        form = "2"
    elif 9 <= len(digits) <= 15 and re.search(r"[ ()-]", span):
        form = "3"
    else:
        form = str(NONE)
    edges = str(NONE) if touches and not address else ABSTAIN
    shape = "a" if address else "o" if octets else "+" if span[0] == "+" else "(" if "(" in span else "n"
    seps = "".join(sorted(set(c for c in span if c in " .-")))
    features = f"{shape}|{min(len(digits), 20)}|{seps}|{context}|{int(touches)}|{'@' if '@' in span else ''}|{form}"
    return features, pattern + gazetteer + context + form + edges


LABELERS = 5
VOTES = {ABSTAIN: NONE + 1} | {str(k): k for k in range(NONE + 1)}


@dataclass
class SpanModel:
    """Weights of a softmax classifier over the parts of a span's description."""

    names: dict[str, int]
    weights: np.ndarray
    reliabilities: np.ndarray

    def chances(self, features: str) -> np.ndarray:
        rows = [self.names[f] for f in _parts(features) if f in self.names]
        return _softmax(self.weights[rows].sum(axis=0) + self.weights[-1])


def _parts(features: str) -> list[str]:
    return [f"{i}{part}" for i, part in enumerate(features.split("|"))] + ["*" + features]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60):
    """Expectation-maximisation over vote patterns: chances of each class for every pattern, and
    for each labeler the chance of each vote given the class. Labelers start as mostly right."""
    classes, kinds = NONE + 1, NONE + 2
    table = np.full((LABELERS, classes, kinds), 0.1)
    for c in range(classes):
        table[:, c, c] = 1.0
        table[:, c, kinds - 1] = 0.6
    table /= table.sum(axis=2, keepdims=True)
    prior = np.full(classes, 1 / classes)
    for _ in range(rounds):
        log = np.log(prior) + sum(np.log(table[i][:, votes[:, i]]).T for i in range(LABELERS))
        chance = _softmax(log)
        mass = chance * counts[:, None]
        prior = (mass.sum(axis=0) + 1) / (mass.sum() + classes)
        for i in range(LABELERS):
            for v in range(kinds):
                table[i][:, v] = mass[votes[:, i] == v].sum(axis=0) + 0.1
        # Pseudo-counts on the diagonal keep a kind that never occurs from taking another's place.
        table[:, np.arange(classes), np.arange(classes)] += 1.0
        table /= table.sum(axis=2, keepdims=True)
    return chance, table


def train(docs: DataFrame, text: str = "text") -> SpanModel:
    """Fit on every candidate span of every whole text.

    What reaches the driver is the number of spans for each description: its parts are classes
    with few values, so their number doesn't grow with the input.
    """
    import pyarrow as pa

    def describes(batches):
        for batch in slices(batches):
            found = []
            for t in batch.column(0).to_pylist():
                if spans := candidates(t or ""):
                    base = base_spans(t)
                    found += [describe(t, s, e, base) for s, e in spans]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["f", "v"])

    spans = docs.select(F.col(text).alias("t")).filter("t is not null").mapInArrow(describes, "f string, v string")
    rows = sorted(spans.groupBy("f", "v").count().collect())
    names: dict[str, int] = {}
    for r in rows:
        for part in _parts(r["f"]):
            names.setdefault(part, len(names))
    weights = np.zeros((len(names) + 1, NONE + 1))
    if not rows:
        weights[-1, NONE] = 10
        return SpanModel(names, weights, np.zeros((LABELERS, NONE + 1, NONE + 2)))
    votes = np.array([[VOTES[c] for c in r["v"]] for r in rows])
    counts = np.array([r["count"] for r in rows], dtype=float)
    chance, table = reliabilities(votes, counts)
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [names[p] for p in _parts(r["f"])]] = 1
    share = (np.sqrt(counts) / np.sqrt(counts).sum())[:, None]
    slope = np.full(weights.shape, 1e-8)
    for _ in range(400):
        grad = x.T @ ((_softmax(x @ weights) - chance) * share) + 1e-5 * weights
        slope += grad**2
        weights -= 0.3 * grad / np.sqrt(slope)
    return SpanModel(names, weights, table)


def spans_of(text: str, model: SpanModel, least: float = 0.9):
    """(base spans, all spans) of a text. A span is added where the classifier gives a kind a
    chance of at least `least` and no base or earlier span is touched; base spans stay."""
    base = base_spans(text)
    added: list[tuple[int, int, int]] = []
    for start, end in candidates(text):
        if any(s < end and start < e for s, _, e in base + added[-1:]):
            continue
        chance = model.chances(describe(text, start, end, base)[0])
        kind = int(chance.argmax())
        if kind != NONE and chance[kind] >= least:
            added.append((start, kind, end))
    return base, sorted(base + added)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join(out) + text[at:]


SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: SpanModel, key: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """One row per input row: key, base counts, digest of the base spans, all spans.

    Offsets are code points, ends exclusive. A null or empty text has no spans; repeated rows are
    answered each for itself; very long texts are searched whole; an empty table gives no rows.
    Other columns are not read.
    """
    import pyarrow as pa

    def found(batches):
        for batch in slices(batches):
            both = [spans_of(t or "", model, least) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in b) for b, _ in both], pa.int64()) for i in range(NONE)]
            digests = [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([written(a) for _, a in both], pa.string())],
                ["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(found, "key long, " + SPANS)


def with_redaction(docs: DataFrame, model: SpanModel, text: str = "text", least: float = 0.9) -> DataFrame:
    """All rows and columns, every found span of the text replaced by its kind; null stays null."""
    import pyarrow as pa

    at = docs.columns.index(text)

    def clean(batches):
        for batch in slices(batches):
            texts = [t and redacted(t, spans_of(t, model, least)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(clean, T.StructType(docs.schema.fields))
