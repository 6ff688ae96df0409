"""Language identification in two steps: a language family, then within it one linear support
vector machine for each pair of its languages."""

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbora.llm.common import slices
from nimbora.llm.ngrams import bounded_sample, fold, hashed_ngrams

SIZES = (1, 2, 3)
BITS = 12
#: Bound of the training sample: so many documents of each language.
PER_LANGUAGE = 400
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")

#: Families of common language codes; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "semitic": "ar he mt am".split(),
    "indic": "hi ur bn mr ne pa gu si".split(),
    "iranian": "fa ku ps tg".split(),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


def vector(text: str, sizes=SIZES, bits=BITS) -> np.ndarray:
    """Unit vector of damped n-gram counts over letters and single spaces of the whole text."""
    kept = NOT_LETTERS.sub(" ", text.lower()).strip()
    counts = np.bincount(hashed_ngrams(f" {kept} ", sizes, bits), minlength=1 << bits)
    damped = np.sqrt(counts).astype(np.float32)
    return damped / max(float(np.linalg.norm(damped)), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    """Weights of the family machines and, by family, of its pairs of languages."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pair_weights: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and confidence; `und` and 0 for texts without a letter or without a model."""
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = np.append(vector(text), np.float32(1))
        margins = self.family_weights @ x
        best = int(np.argmax(margins))
        others = np.delete(margins, best)
        sure = _chance(margins[best] - others.max()) if len(others) else 1.0
        name = self.families[best]
        members = self.members[name]
        votes, firm = np.zeros(len(members)), np.zeros(len(members))
        for a, b, w in self.pair_weights[name]:
            margin = float(w @ x)
            votes[a if margin >= 0 else b] += 1
            firm[a] += margin
            firm[b] -= margin
        # Most votes, then the larger sum of margins, then the order of names.
        language = max(range(len(members)), key=lambda i: (votes[i], firm[i], -i))
        if len(members) > 1:
            sure *= _chance(2 * firm[language] / (len(members) - 1))
        return members[language], float(sure)


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(margin, -15, 15))))


def support_vector_machine(x: np.ndarray, y: np.ndarray, rounds: int = 120, penalty: float = 1e-4) -> np.ndarray:
    """Hinge loss with an L2 penalty by averaged subgradient steps; classes weigh the same."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    y, share = y.astype(np.float32), share.astype(np.float32)
    w, mean = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    slope = np.full(x.shape[1], 1e-8, np.float32)
    for i in range(rounds):
        active = np.where(y * (x @ w) < 1, share * y, np.float32(0))
        grad = np.float32(penalty) * w - active @ x
        slope += grad**2
        w = w - np.float32(0.5) * grad / np.sqrt(slope)
        mean += w * (i >= rounds // 2)
    return mean / (rounds - rounds // 2)


def fit(vectors: np.ndarray, languages: list[str], family_of=FAMILY_OF) -> LanguageModel:
    if not len(languages):
        return LanguageModel()
    x = np.hstack([vectors, np.ones((len(vectors), 1), dtype=np.float32)])
    language = np.array(languages)
    members: dict[str, list[str]] = {}
    for code in sorted(set(languages)):
        members.setdefault(family_of.get(code, code), []).append(code)
    families = sorted(members)
    family = np.array([family_of.get(c, c) for c in languages])
    model = LanguageModel(families, members)
    model.family_weights = np.stack(
        [support_vector_machine(x, np.where(family == f, 1, -1)) for f in families]
    )
    for name, codes in members.items():
        model.pair_weights[name] = []
        for a, b in combinations(range(len(codes)), 2):
            rows = (language == codes[a]) | (language == codes[b])
            y = np.where(language[rows] == codes[a], 1, -1)
            model.pair_weights[name].append((a, b, support_vector_machine(x[rows], y)))
    return model


def train(
    docs: DataFrame, folds: int = 3, held_out: int = 1, per_language: int = PER_LANGUAGE,
    key: str = "doc_id", text: str = "text", language: str = "lang",
) -> LanguageModel:
    """Fit on at most `per_language` documents of each language outside the held-out fold.

    Null keys and languages and texts without a letter are left out. The sample is what reaches
    the driver; without any row, every text is `und`.
    """
    import pyarrow as pa

    known = docs.select(F.col(key).alias("k"), F.col(language).cast("string").alias("y")).filter(
        F.col("k").isNotNull() & F.col("y").isNotNull() & (fold(F.col("k"), folds) != held_out)
    )
    sample = bounded_sample(known.distinct(), per_language, "y", "k")

    def vectors(batches):
        for batch in slices(batches):
            kept = [(y, t) for y, t in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([y for y, _ in kept], pa.string()),
                    pa.array([vector(t).tobytes() for _, t in kept], pa.binary()),
                ],
                ["y", "v"],
            )

    # At most per_language rows for each language, so the sample may be broadcast.
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null")
    chosen = texts.join(F.broadcast(sample), "k").select(F.col("k").cast("string"), "t", "y")
    rows = sorted(chosen.mapInArrow(vectors, "y string, v binary").collect())
    width = 1 << BITS
    x = np.frombuffer(b"".join(r["v"] for r in rows), dtype=np.float32).reshape(-1, width)
    return fit(x, [r["y"] for r in rows])


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", names=("lang_pred", "score")) -> DataFrame:
    """All columns and rows of `docs`, the predicted language of each whole text, its confidence.
    The two names must not be among the columns; the text is the only input of a prediction."""
    import pyarrow as pa

    at = docs.columns.index(text)

    def predicted(batches):
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return docs.mapInArrow(predicted, T.StructType([*docs.schema.fields, *added]))
