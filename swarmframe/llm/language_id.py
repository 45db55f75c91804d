"""Language identification with string kernels.

A text is the set of its blended-spectrum n-grams (lengths 1 to 3, present or
not) over lower-cased letters, with all else read as a space. The kernel of two
texts is the cosine of these sets. Landmark texts give the Nyström map
``K(x, landmarks) K(landmarks, landmarks)^-1/2``; kernel ridge regression, one
language against the rest, is solved on it. As the kernel is linear in the
presence vector but for a row's norm, landmarks, map and regression fold into
one matrix, and a batch is scored by one product of presence rows with it.

Only the model is fitted on a bounded sample: ``PER_LANGUAGE`` rows of each
language, taken by a hash of the id; with many languages fewer of each, down to
one, so that ``LABELLED`` rows and ``CENTRES`` landmarks are not exceeded by more
than one for each language. Every language there is can be learned. What leaves
the executors for the fit are presence rows of at most 8 KB, not texts. Every
text is scored, whole.

Defined results: a null text, or one without a letter, gives ``und`` and score
0; ties go to the language first in order; if no row can be learned from, all
are ``und``. Repeated rows and extra columns have no effect on each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table

UNKNOWN = "und"
#: n-grams are kept by a hash of so many bits.
GRAM_BITS = 16
#: Documented bounds of the fit: rows and landmarks of each language, and of all languages.
PER_LANGUAGE, LANDMARKS, LABELLED, CENTRES = 300, 64, 20_000, 1024
#: A document of the pipeline stays if its best language leads by so much or more: 1 is the lead of a text that is all in
#: one language, 0 that of one that is half in another or in none that was learned.
LEAST_MARGIN = 0.5
RIDGE = 1e-3
BATCH = 64


def letters_table() -> np.ndarray:
    """Code points below 2**16 to their lower-case letter, all else to a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Grams:
    """Marks the n-grams of a text in a row of zeros and ones."""

    def __init__(self) -> None:
        self.letters = letters_table()

    def mark(self, text: str | None, row: np.ndarray) -> bool:
        """False where there is no letter; the row is then left as it was."""
        points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        if not len(points):
            return False
        if points.max() >> 16:  # beyond the table: letters there stand for themselves
            far = np.array([p if chr(p).isalpha() else 32 for p in points[points >> 16 > 0].tolist()], np.uint32)
            low = self.letters[np.minimum(points, 0xFFFF)]
            low[points >> 16 > 0] = far
        else:
            low = self.letters[points]
        if not (low != 32).any():
            return False
        low = np.concatenate(([np.uint32(32)], low, [np.uint32(32)]))
        one = low * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x2545F491)) * np.uint32(0x85EBCA77) + low[1:] * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + low[2:] * np.uint32(0x9E3779B1)
        shift = np.uint32(32 - GRAM_BITS)
        for h in (one, two, three):
            row[(h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift] = 1
        return True


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # n-grams x languages

    def scorer(self):
        grams = Grams()

        def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
            names: list[str] = []
            scores: list[float] = []
            for start in range(0, len(texts), BATCH):
                part = texts[start : start + BATCH]
                rows = np.zeros((len(part), 1 << GRAM_BITS), np.uint8)
                known = np.array([grams.mark(t, rows[i]) for i, t in enumerate(part)], bool)
                if not self.languages:
                    names += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                x = rows.astype(np.float32)
                out = (x @ self.weights) / np.sqrt(np.maximum(1, x.sum(1)))[:, None]
                top = out.argmax(1)
                best = out[np.arange(len(part)), top]
                rest = np.where(np.arange(out.shape[1])[None, :] == top[:, None], -np.inf, out).max(1) if out.shape[1] > 1 else np.full(len(part), -1.0)
                margin = np.clip((best - rest) / 2, 0, 1)
                names += [self.languages[k] if ok else UNKNOWN for k, ok in zip(top, known, strict=True)]
                scores += [float(m) if ok else 0.0 for m, ok in zip(margin, known, strict=True)]
            return names, scores

        return score


def fit_language_model(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Nyström landmarks are the first texts of each language; rows without a letter teach nothing."""
    grams, rows, names = Grams(), [], []
    for text, lang in zip(texts, langs, strict=True):
        row = np.zeros(1 << GRAM_BITS, np.uint8)
        if grams.mark(text, row):
            rows.append(np.flatnonzero(row))
            names.append(lang)
    return fit_rows(rows, names, landmarks, ridge)


def fit_rows(rows: list[np.ndarray], names: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """The model of rows given by the n-grams they hold."""
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], np.zeros((1 << GRAM_BITS, 0), np.float32))
    places: dict[str, list[int]] = {lang: [] for lang in languages}
    for k, lang in enumerate(names):
        places[lang].append(k)
    landmarks = max(1, min(landmarks, CENTRES // len(languages)))
    chosen = [i for lang in languages for i in places[lang][:landmarks]]
    marks = np.zeros((len(chosen), 1 << GRAM_BITS), np.float32)
    for k, i in enumerate(chosen):
        marks[k, rows[i]] = 1 / np.sqrt(len(rows[i]))
    square = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(square)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.array([marks[:, r].sum(1) / np.sqrt(len(r)) for r in rows], np.float64)
    features = kernel @ root
    goal = np.where(np.array(names)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = np.where(goal > 0, 0.5 / np.maximum(1, (goal > 0).sum(0)), 0.5 / np.maximum(1, (goal < 0).sum(0)))
    solved = np.empty((features.shape[1], len(languages)))
    for k in range(len(languages)):  # each language weighs as much as the rest
        weighed = features * weight[:, k : k + 1]
        solved[:, k] = np.linalg.solve(features.T @ weighed + ridge * np.eye(features.shape[1]), weighed.T @ goal[:, k])
    return LanguageModel(languages, (marks.T @ (root @ solved).astype(np.float32)).astype(np.float32))


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 5 == 0


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel:
    """Fits on at most ``per_language`` rows of each language among those not held out.

    Counts of each language over all rows set the share of its hash range to
    take, so that hardly more than the bound ever leaves the executors.
    """
    rows = docs.select(F.xxhash64(docs[id_col], F.lit(7)).alias("h"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return fit_rows([], [])
    per_language = max(1, min(per_language, LABELLED // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.2 * per_language + 8) / r["count"])) for r in counts], "lang string, share double")
    part = rows.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned("h", 1) / F.lit(2.0**63) < F.col("share"))  # a row for each language

    def marks() -> Callable:
        grams = Grams()

        def mark(texts: list[str | None]) -> list[list]:
            out = []
            for text in texts:
                row = np.zeros(1 << GRAM_BITS, np.uint8)
                known = grams.mark(text, row)
                out.append(np.packbits(row).tobytes() if known else None)
            return [out]

        return mark

    found = append_columns(part.select("h", "lang", "text"), [T.StructField("bits", T.BinaryType())], "text", marks).select("h", "lang", "bits").where("bits IS NOT NULL")
    taken: dict[str, list[bytes]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["h"], bytes(r["bits"]))):
        if len(own := taken.setdefault(r["lang"], [])) < per_language:
            own.append(bytes(r["bits"]))
    pairs = [(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))), lang) for lang in sorted(taken) for b in taken[lang]]
    return fit_rows([x for x, _ in pairs], [lang for _, lang in pairs], landmarks)


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then ``lang_pred`` and ``lang_score``."""
    handle = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))  # n-grams x languages floats: 256 KB for each language
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    return append_columns(docs, fields, text_col, lambda: LanguageModel(*handle.value).scorer())


def keep_identified(docs: DataFrame, model: LanguageModel, languages: frozenset[str] | None = None, least_margin: float = 0.0, text_col: str = "text") -> DataFrame:
    """The documents whose language is known by ``least_margin`` or more (and among ``languages``, if given), as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = identify_languages(rows, model)
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least_margin)
    return scored.where(good & F.col("lang_pred").isin(*languages) if languages else good).select("row.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return identify_languages(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op2_language_id": op2_language_id}
