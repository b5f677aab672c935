"""Counterfactual-regularised toxicity classifier.

Sparse logistic regression over words and word beginnings (presence in the whole text). Beside every labelled text of the
fit stand SWAPS copies in which a term that names a group is swapped for another one of its language; where a text
names none, a word of one of its sentences gives way to one term and to another. The loss adds the squared change of the
score from one copy to the other, so what a text says of a group counts and which group it names does not. The fit
takes a bounded sample of labelled rows (SAMPLE a class, chosen by a hash of doc_id); scoring is one pass over whole texts
without a shuffle.

Defined results: null or empty text has no features and scores as the intercept says; labels that are null or belong
to no document are ignored; of several labels of one doc_id the toxic one counts; without both classes among the labels
every score is the share of toxic ones; extra columns are not read; a null doc_id counts as held out; repeated rows get
equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.text import carried, chunks, emit, parts
from assayer.plans.store import Scratch

#: Labelled rows of each class that the fit uses at most.
SAMPLE = 4000
FEATURES = 20_000
PENALTY, RIDGE, STEPS = 4.0, 3e-3, 250
PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
#: Copies with a swapped term for each labelled text.
SWAPS = 4
#: Words that name groups, by language.
IDENTITY = {
    "en": (
        "woman women man men girl girls boy boys muslim muslims christian christians jew jews jewish hindu hindus atheist atheists black blacks white whites asian asians "
        "african africans latino latinos immigrant immigrants migrant migrants refugee refugees foreigner foreigners gay gays lesbian lesbians bisexual transgender queer "
        "homosexual homosexuals heterosexual disabled blind deaf elderly poor"
    ).split(),
    "fr": (
        "femme femmes homme hommes fille filles garçon garçons musulman musulmans musulmane chrétien chrétiens chrétienne juif juifs juive hindou hindous athée athées noir noirs noire "
        "blanc blancs blanche asiatique asiatiques africain africains immigré immigrés réfugié réfugiés étranger étrangers gay lesbienne lesbiennes homosexuel homosexuels handicapé handicapés sourd aveugle vieux pauvre"
    ).split(),
    "de": (
        "frau frauen mann männer mädchen junge jungen muslim muslime muslimisch christ christen christlich jude juden jüdisch hindu hindus atheist atheisten schwarz schwarze weiß weiße "
        "asiate asiaten afrikaner einwanderer migrant migranten flüchtling flüchtlinge ausländer schwul schwule lesbe lesben homosexuell homosexuelle behindert behinderte blind taub alte arme"
    ).split(),
    "es": (
        "mujer mujeres hombre hombres niña niñas niño niños musulmán musulmanes musulmana cristiano cristianos cristiana judío judíos judía hindú hindúes ateo ateos negro negros negra "
        "blanco blancos blanca asiático asiáticos africano africanos inmigrante inmigrantes refugiado refugiados extranjero extranjeros gay lesbiana lesbianas homosexual homosexuales discapacitado discapacitados ciego sordo anciano pobre"
    ).split(),
}
_LANGUAGES = {t: some for some in IDENTITY.values() for t in some}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[int]:
    """64-bit codes of the word and of its beginnings; the mark keeps the two kinds apart."""
    return [code(word), *(code(word[:n] + "~") for n in PREFIXES if len(word) > n)]


def code(feature: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(feature), "big", signed=True)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    index: dict[int, int]
    weights: np.ndarray
    intercept: float

    def scorer(self, most: int = 400_000):
        index, weights = self.index, self.weights

        class Known(dict):
            """Word to its features in the model; for nearly all words none."""

            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= most:
                    self.clear()
                self[word] = out = tuple(i for f in features(word) if (i := index.get(f)) is not None)
                return out

        known = Known()

        def score(text: str | None) -> float:
            held = {i for found in map(known.__getitem__, words(text)) if found for i in found}
            return 1 / (1 + np.exp(-(self.intercept + (weights[sorted(held)].sum() if held else 0.0))))

        return score


_SENTENCE = re.compile(r"[.!?\n]+")


def swaps(text: str | None) -> list[tuple[list[int], list[int]]]:
    """(features that go, features that come) from a text with one term to its copy with another.

    Which terms meet is chosen by a hash of the text. A feature that another word of the text has too neither goes nor comes.
    """
    held = words(text)
    if not held:
        return []
    pick = xxhash.xxh3_64_intdigest(text)
    times = Counter(f for w in held for f in features(w))
    named = sorted(held & _LANGUAGES.keys())
    sentences = [s for s in map(words, _SENTENCE.split(text)) if s]
    out = []
    for k in range(SWAPS):
        turn = pick >> (13 * k)
        if named:
            gone = one = named[turn % len(named)]
            terms = _LANGUAGES[one]
        else:  # a word of a sentence gives way
            sentence = sorted(sentences[turn % len(sentences)])
            gone = sentence[(turn >> 3) % len(sentence)]
            terms = list(IDENTITY.values())[(turn >> 5) % len(IDENTITY)]
            one = terms[(turn >> 7) % len(terms)]
        other = terms[(turn >> 9) % len(terms)]
        once = set(features(gone))
        alone = lambda term: {f for f in features(term) if times[f] == (f in once)}  # noqa: B023, E731  that no word of the rest has
        before, after = alone(one), alone(other)
        out.append((sorted(before - after), sorted(after - before)))
    return out


def sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """toxic, codes (distinct features), swaps: at most ``most`` labelled doc_ids of each class, none held out."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    chosen = some[0].union(some[1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("gone", pa.list_(pa.int64())), ("come", pa.list_(pa.int64()))])
        schema = pa.schema([("toxic", pa.int32()), ("codes", pa.list_(pa.int64())), ("swaps", pa.list_(pair))])
        for part in chunks(batches, 1):
            yield emit([(t, sorted({f for w in words(x) for f in features(w)}), [{"gone": g, "come": c} for g, c in swaps(x)]) for t, x in part], schema)

    texts = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # 2 * most rows
    return joined.mapInArrow(cut, "toxic int, codes array<long>, swaps array<struct<gone:array<long>,come:array<long>>>")


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE, penalty: float = PENALTY) -> Model:
    totals = {r["toxic"]: r["n"] for r in labels.where("toxic in (0, 1)").where(~held_out()).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = Scratch(documents.sparkSession, "toxicity").keep(sample(documents, labels, most), "sample")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        share = (n1 / (n1 + n0) if n1 + n0 else 0.0) * 0.998 + 0.001
        return Model({}, np.zeros(0), float(np.log(share / (1 - share))))
    # Features whose presence tells the classes apart most are kept; their counts are added up on the executors.
    seen = rows.select("toxic", F.explode("codes").alias("f")).groupBy("f").agg(F.sum("toxic").alias("seen1"), F.count("*").alias("seen")).where("seen >= 3")
    p, q = (F.col("seen1") + 0.5) / (n1 + 1), (F.col("seen") - F.col("seen1") + 0.5) / (n0 + 1)
    worth = F.abs(p - q) / F.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)
    best = seen.select("f", worth.alias("worth")).where("worth > 2.5").orderBy(F.desc("worth"), "f").limit(FEATURES).collect()
    index = {r["f"]: i for i, r in enumerate(best)}
    held = documents.sparkSession.sparkContext.broadcast(index)  # FEATURES entries

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = held.value, pa.list_(pa.int32())
        schema = pa.schema([("toxic", pa.int32()), ("at", numbers), ("gone", pa.list_(numbers)), ("come", pa.list_(numbers))])
        of = lambda codes: [known[c] for c in codes if c in known]
        for part in chunks(batches, 1):
            yield emit([(t, of(codes), [of(s["gone"]) for s in swapped], [of(s["come"]) for s in swapped]) for t, codes, swapped in part], schema)

    small = rows.mapInArrow(place, "toxic int, at array<int>, gone array<array<int>>, come array<array<int>>").collect()  # 2 * most rows of chosen features
    small.sort(key=lambda r: (r["toxic"], r["at"], r["gone"], r["come"]))  # the sums below do not depend on which task came first
    y = np.array([r["toxic"] for r in small], float)
    rows_ = np.repeat(np.arange(len(small)), [len(r["at"]) for r in small])
    cols = np.array([c for r in small for c in r["at"]], np.int64)
    changes = _changes([(g, c) for r in small for g, c in zip(r["gone"], r["come"], strict=True) if g or c])
    share = totals.get(1, n1) / max(1, totals.get(1, n1) + totals.get(0, n0))
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    w, b = _descend(rows_, cols, y, weight, changes, len(best), penalty)
    return Model(index, w, b)


def _changes(swapped: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, -1 or 1) of every swap that touches a chosen feature."""
    at = np.repeat(np.arange(len(swapped)), [len(g) + len(c) for g, c in swapped])
    features_ = np.array([f for g, c in swapped for f in (*g, *c)], np.int64)
    signs = np.array([x for g, c in swapped for x in (-1.0,) * len(g) + (1.0,) * len(c)])
    return at, features_, signs


def _descend(rows_, cols, y, weight, changes, width, penalty) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum and per-coordinate scaling on the convex loss."""
    w, b, n = np.zeros(width), float(np.log(weight[y == 1].sum() / weight[y == 0].sum())), len(y)
    swap, moved, signs = changes
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = b + np.bincount(rows_, weights=w[cols], minlength=n)
        r = weight * (1 / (1 + np.exp(-z)) - y) / n
        g = np.bincount(cols, weights=r[rows_], minlength=width) + RIDGE * w / 10
        if len(swap):
            change = np.bincount(swap, weights=signs * w[moved])
            g += penalty * 2 * np.bincount(moved, weights=signs * change[swap], minlength=width) / len(change)
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.05 if t < 200 else 0.01
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return _scored(docs, 1, model).select("doc_id", "score")


def _scored(docs: DataFrame, text_at: int, model: Model) -> DataFrame:
    """Adds ``score`` to rows whose text is column ``text_at``."""
    held = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.intercept))  # FEATURES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Model(*held.value).scorer()
        for part in parts(batches, text_at):
            scores = pa.array([one(t.as_py()) for t in part.column(text_at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def verdicts(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score below a half."""
    coded, text_at, back = carried(documents)
    return _scored(coded, text_at, fit(documents, labels)).where("score < 0.5").select(back)
