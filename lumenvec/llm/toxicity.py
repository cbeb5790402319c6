"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Everything learned comes from labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``FIT_ROWS`` of them
(those with the smallest hashes), so the cost of learning has a bound; every row is scored, on its whole text.

Lexicon: words and word beginnings of 4 to 6 letters whose presence in texts tells toxic from clean ones by a G-test, at
most ``LEXICON`` of them. Features: densities and numbers of lexicon words and beginnings, how near a second-person
pronoun they stand, second-person density, capitals, shouted words, marks, other punctuation, obfuscated words (letters
mixed with digits or symbols, also as lexicon hits once undone), and length. No feature sees label, language, source or
id. Four fifths of the learning rows grow the trees, one fifth calibrates them.

Defined results: null and empty texts have all-zero features and get the score those have; a null doc_id is not held
out; labels of a doc_id that is labelled twice count as toxic if one does; without labelled rows, or with one class
only, every score is the labelled share of toxic rows (0 without any); repeated rows get equal scores; extra columns are
ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import spare_name, written

FIT_ROWS = 20_000
LEXICON, MIN_G = 500, 24.0
FOLDS = 5
TREES, DEPTH = 20, 3
NEAR = 5
_TOKENS = 400_000

#: Second-person forms, fixed values.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti usted ustedes vosotros os tus su sus".split()
)
#: Look-alikes of letters, fixed values.
LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})
EDGE = " \t\r\n.,;:!?\"'()[]{}<>|*#$%&+=~`«»“”‘’…"
MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d@$!*|]).{3,}")
UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
N_FEATURES = 14


def terms_of(text: str) -> set[str]:
    """Words (as ``=word``) and beginnings of a text."""
    out = set()
    for w in {t.strip(EDGE) for t in text.lower().split()}:
        if 2 <= len(w) <= 40:
            out.add(f"={w}")
            out.update(w[:k] for k in (4, 5, 6) if len(w) > k)
    return out


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    stems: frozenset[str]

    def kind(self, token: str) -> tuple[int, int, int, int]:
        """Of a token as it stands: lexicon word, lexicon beginning, obfuscated, second person (each 0 or 1)."""
        w = token.lower().strip(EDGE)
        you = int(w in SECOND_PERSON)
        word, stem = int(w in self.words), int(any(w[:k] in self.stems for k in (4, 5, 6) if len(w) > k))
        mixed = 0
        if not word and not stem and MIXED.fullmatch(token):
            plain = token.lower().strip(".,;:?\"'()[]{}").translate(LOOKS)
            if plain in self.words or any(plain[:k] in self.stems for k in (4, 5, 6) if len(plain) > k):
                word, mixed = 1, 1
        return word, stem, mixed, you


def features(text: str, lexicon: Lexicon, known: dict[str, tuple[int, int, int, int]]) -> list[float]:
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * N_FEATURES
    if len(known) > _TOKENS:
        known.clear()
    kinds = {}
    for t in set(tokens):
        k = known.get(t)
        if k is None:
            k = known[t] = lexicon.kind(t)
        if any(k):
            kinds[t] = k
    words = stems = mixed = yous = near = 0
    distinct = sum(1 for k in kinds.values() if k[0] or k[1])
    if kinds:
        last_you = last_hit = -NEAR - 1
        for i, t in enumerate(tokens):
            k = kinds.get(t)
            if k is None:
                continue
            words, stems, mixed, yous = words + k[0], stems + k[1], mixed + k[2], yous + k[3]
            if k[0] or k[1]:
                near += i - last_you <= NEAR
                last_hit = i
            if k[3]:
                near += i - last_hit <= NEAR
                last_you = i
    marks = text.count("!") + text.count("?")
    other = sum(text.count(c) for c in "#*$%&|<>")
    upper = len(UPPER.findall(text))
    shouted = sum(1 for t in tokens if len(t) > 2 and t.isupper()) if upper > n else 0
    return [
        words / n, math.log1p(words), stems / n, math.log1p(stems), math.log1p(distinct), near / n, math.log1p(near),
        yous / n, upper / len(text), shouted / n, marks / n, other / len(text), mixed / n, math.log1p(n),
    ]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
            terms = sorted(terms_of(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic] * len(terms), pa.int32())], ["term", "toxic"])


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """From ``rows`` (text, toxic): the terms that tell toxic texts best, at most LEXICON."""
    counts = rows.mapInArrow(_terms, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c"))
    share, n = n_toxic / (n_toxic + n_clean), F.col("a") + F.col("c")
    g = 2 * (F.when(F.col("a") > 0, F.col("a") * F.log(F.col("a") / (n * share))).otherwise(0.0) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0))
    best = counts.withColumn("g", g).filter((F.col("g") >= MIN_G) & (F.col("a") > 0.7 * n)).orderBy(F.desc("g"), "term").limit(LEXICON).collect()
    terms = [r["term"] for r in best]
    return Lexicon(frozenset(t[1:] for t in terms if t[0] == "="), frozenset(t for t in terms if t[0] != "="))


def _featured(lexicon: Lexicon, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int, int, int]] = {}
        for b in batches:
            x = [features(t or "", lexicon, known) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            keep = [i for i in range(b.num_columns) if b.schema.names[i] != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(x, pa.list_(pa.float64()))], [*[b.schema.names[i] for i in keep], name])

    return run


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    """Lexicon, trees and calibration; or a constant share where there was nothing to learn."""

    share: float
    lexicon: Lexicon | None = None
    trees: object = None
    calibration: object = None

    def score(self, df: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
        """``keep`` columns of ``df`` (which has text), and the score."""
        if self.lexicon is None:
            return df.select(*keep, F.lit(float(self.share)).alias(name))
        schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
        x = df.select(*keep, "text").mapInArrow(_featured(self.lexicon, "_x"), f"{schema}, _x array<double>")
        raw = self.trees.transform(x.withColumn("_features", array_to_vector("_x")))
        raw = raw.select(*keep, vector_to_array("probability")[1].alias("_raw"))
        out = self.calibration.transform(raw.withColumn("_at", array_to_vector(F.array("_raw"))))
        return out.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated"))).alias(name))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from at most ``fit_rows`` labelled rows that are not held out, one text for each id (that with the smallest hash)."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # fit_rows pairs of numbers at most are broadcast
    mine = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = written(mine.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "fit_rows")
    n_toxic, n = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not n or n_toxic in (0, n):
        return Model(share=(n_toxic or 0) / n if n else 0.0)
    lexicon = learn_lexicon(rows, n_toxic, n - n_toxic)
    x = rows.select("doc_id", "toxic", "text").mapInArrow(_featured(lexicon, "_x"), "doc_id long, toxic int, _x array<double>")
    x = written(x.select(F.col("toxic").cast("double").alias("label"), "_x", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("calibrates")), "fit_features").withColumn("_features", array_to_vector("_x"))
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=10, maxBins=32).fit(x.filter(~F.col("calibrates")))
    raw = trees.transform(x.filter("calibrates")).select("label", array_to_vector(F.array(vector_to_array("probability")[1])).alias("_at"))
    if raw.agg(F.countDistinct("label")).first()[0] < 2:  # too few to calibrate on: all learning rows then
        raw = trees.transform(x).select("label", array_to_vector(F.array(vector_to_array("probability")[1])).alias("_at"))
    calibration = IsotonicRegression(featuresCol="_at", labelCol="label", predictionCol="_calibrated").fit(raw)
    return Model(n_toxic / n, lexicon, trees, calibration)


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = fit(rows, labels, fit_rows).score(rows, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are."""
    name, body = spare_name(docs, "toxicity"), spare_name(docs, "whole_row")
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, fit_rows)
    carried = docs.select(F.struct(*docs.columns).alias(body), F.col("text").alias("text"))
    return model.score(carried, [body], name).filter(F.col(name) < threshold).select(f"{body}.*")
