"""Language identification in two steps: the family, then the language within it.

Families come from a fixed table; a language that is not in it is a family of
its own.  Families are told apart by linear SVMs, one against the rest;
languages of one family by linear SVMs, one against one, whose votes and
margins are summed.  Features are hashed character n-grams of whole texts, lower-cased, with all but
letters folded to spaces.

Every language with a label is learned.  The model is fitted on at most about
``PER_LANGUAGE`` labelled documents for each language, drawn by a hash of the
id, and on about ``SAMPLE`` in all where there are so many languages.  Text that
is null or has no letter is ``und`` with score 0, as is all text where nothing
was learned; equal votes go to the later code.  Texts of any length are counted
whole.  Repeated rows get equal results; an empty table gives an empty result.
Columns named ``lang_pred`` or ``score`` are refused.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.llm.common import refuse, texts
from objectlake.llm.features import Sparse, char_counts, fit, has_letter, normal, platt, sigmoid, thin

#: Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu", "ur"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

UNKNOWN = "und"
ORDERS, BITS = (1, 2, 3), 12
PER_LANGUAGE, SAMPLE = 800, 40_000
PENALTY = 1e-4


def vector(text: str) -> np.ndarray:
    return normal(char_counts(text, ORDERS, BITS, True))


@dataclass
class Model:
    """Families, languages and, for each separator, weights with what they tell apart."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    offsets: np.ndarray | None = None
    scales: list[tuple[float, float]] = field(default_factory=list)
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # (family, language, language), after the families

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """The language and a score from 0 to 1 for each row of features."""
        margins = x @ self.weights + self.offsets if self.weights is not None and self.weights.size else np.zeros((len(x), 0))
        chance = np.stack([sigmoid(a * margins[:, i] + b) for i, (a, b) in enumerate(self.scales)], axis=1) if self.scales else margins
        n = len(self.families) if len(self.families) > 1 else 0
        out = []
        for row in range(len(x)):
            share = chance[row, :n] / max(chance[row, :n].sum(), 1e-12) if n else np.ones(1)
            best = int(share.argmax())
            family, score = self.families[best], float(share[best])
            wins = dict.fromkeys(self.members[family], 0.0)
            for i, (of, a, b) in enumerate(self.pairs):
                if of == family:
                    wins[a] += chance[row, n + i]
                    wins[b] += 1 - chance[row, n + i]
            language = max(wins, key=lambda k: (wins[k], k))
            others = len(wins) - 1
            out.append((language, score * (wins[language] / others if others else 1.0)))
        return out


def train(rows: list[tuple[str, bytes, bytes]]) -> Model:
    """Fits the model on (language, places, values)."""
    languages = sorted({r[0] for r in rows})
    model = Model()
    for code in languages:
        model.members.setdefault(FAMILY.get(code, code), []).append(code)
    model.families = sorted(model.members)
    width = len(ORDERS) << BITS
    found = []

    def separate(some: list, first) -> None:
        y = np.array([1.0 if first(r[0]) else -1.0 for r in some])
        weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
        x = Sparse([r[1:] for r in some], width)
        w, b = fit(x, y, "hinge", PENALTY, weight=weight)
        found.append((w, b))
        model.scales.append(platt(x.dot(w) + b, y))

    if len(model.families) > 1:
        for family in model.families:
            separate(rows, lambda code, family=family: code in model.members[family])
    for family, codes in sorted(model.members.items()):
        for a, b in itertools.combinations(codes, 2):
            separate([r for r in rows if r[0] in (a, b)], lambda code, a=a: code == a)
            model.pairs.append((family, a, b))
    if found:
        model.weights = np.stack([w for w, _ in found], axis=1).astype(np.float32)
        model.offsets = np.array([b for _, b in found], np.float32)
    return model


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Fits a model on a bounded sample of rows with a label; features are made where the texts are."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(lang).count().collect()  # a row for each language
    if not counts:
        return Model()
    each = min(per_language, -(-SAMPLE // len(counts)))
    shares = known.sparkSession.createDataFrame([(r[0], min(1.0, each / r[1])) for r in counts], "_lang string, _share double")
    draw = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_, index, value = [], [], []
            for code, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if has_letter(t):
                    at, x = thin(vector(t))
                    lang_.append(code)
                    index.append(at)
                    value.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(lang_, pa.string()), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["lang", "at", "x"])

    drawn = known.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), draw.alias("_draw")).join(F.broadcast(shares), "_lang").where("_draw < _share")
    sample = drawn.select("_lang", "_text").mapInArrow(run, "lang string, at binary, x binary")
    return train([tuple(r) for r in sample.collect()])


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the rows of ``df``, of which only the text is looked at."""
    refuse(df.columns, ("lang_pred", "score"))
    names = [*df.columns, "lang_pred", "score"]
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = texts(part.column(place))
                some = [i for i, t in enumerate(rows) if model.families and has_letter(t)]
                lang, score = [UNKNOWN] * len(rows), [0.0] * len(rows)
                if some:
                    for i, (a, b) in zip(some, model.predict(np.stack([vector(rows[i]) for i in some])), strict=True):
                        lang[i], score[i] = a, b
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score, pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, lang_pred string, score double")
