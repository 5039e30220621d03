"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguise: case, accents, look-alike letters of other scripts, invisible characters,
digits and signs that stand for letters. A text's hits are summed with their weights, hits inside
an exception phrase are not counted, and the sum, normalised by the text's length, is turned into a
probability.

Lexicon, exceptions and the curve of the probability are learned from a bounded sample of
labelled rows (``SAMPLE`` distinct texts per class, by their hash); nothing but the text enters a score.
A word, or the beginning of words, joins the lexicon when toxic texts have it far more often than
others and in several independent surroundings. Copies of a text count once, and near copies of one
have the same neighbours on one side of a word at least, so neither add to what other texts show nor
take from it.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import materialised, sample_by_hash, table, whole_text

#: Labelled rows per class that the model is fitted on, at most.
SAMPLE = 10_000
#: Most exception phrases.
EXCEPTIONS = 5_000
#: Lengths of the beginnings of words that are tried.
STEMS = (4, 5, 6, 8)
#: A unit needs so many toxic texts and independent surroundings, times the rate of others, and evidence.
MIN_DOCS, MIN_RATIO = 5, 8.0
#: The evidence is the exponent of the bound on the chance that a neutral unit's texts are toxic so often: exp(-10) is 1 in 22 000.
MIN_EVIDENCE = 10.0
MIN_EXCEPTION_DOCS = 3
#: Words added to a text's length, so that one hit in a few words is not everything.
SMOOTHING = 50

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "г": "r", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i",
    "ø": "o", "ł": "l", "đ": "d", "ß": "ss",
}
# Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "€": "e"}
# Ranges of accented, full-width and mathematical letters, which decompose to plain ones.
DECOMPOSED = ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0xFF01, 0xFF5F), (0x1D400, 0x1D800))
INVISIBLE = (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)


def _folding() -> dict[int, str | None]:
    plain: dict[int, str | None] = {}
    for start, end in DECOMPOSED:
        for code in range(start, end):
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
            if base != chr(code):
                plain[code] = base
    letters = {ord(k): v for k, v in {**HOMOGLYPHS, **SIGNS}.items()}
    # l, i and 1 stand for each other, so all become i, in lexicon and text alike.
    one = {ord("l"): "i"}
    folded = {c: "".join(HOMOGLYPHS.get(x, x) for x in v).replace("l", "i") for c, v in plain.items() if v is not None}
    return {**folded, **{c: v.replace("l", "i") for c, v in letters.items()}, **one, **dict.fromkeys(INVISIBLE)}


FOLDING = _folding()
_BANG = re.compile(r"!(?=\w)")
_WORDS = re.compile(r"\w+")


def fold(text: str) -> str:
    """The text as it is matched: folded letters, single blanks. ``!`` is an i only before a letter."""
    if "!" in text:
        text = _BANG.sub("i", text)
    return " ".join(text.lower().translate(FOLDING).split())


class Model(NamedTuple):
    """Weights of folded words and beginnings (``stem*``), folded exception phrases, and the logistic curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        patterns: dict[str, list] = {}
        for unit, weight in model.weights.items():
            patterns.setdefault(unit.rstrip("*"), []).append((weight, unit[-1] != "*"))
        for phrase in model.exceptions:
            patterns.setdefault(phrase, []).append((None, True))
        for pattern, kinds in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), kinds))
        if patterns:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the best unit of each word of the lexicon outside exception phrases."""
        words: dict[int, tuple[int, int, float]] = {}
        excepted = []
        for last, (length, kinds) in self.automaton.iter(folded) if self.model.weights else ():
            start, end = last - length + 1, last + 1
            if start and folded[start - 1].isalnum():
                continue
            ends = end == len(folded) or not folded[end].isalnum()
            for weight, whole in kinds:
                if whole and not ends:
                    continue
                if weight is None:
                    excepted.append((start, end))
                elif start not in words or weight > words[start][2]:
                    words[start] = (start, end, weight)
        return [w for w in words.values() if not any(s <= w[0] and w[1] <= e for s, e in excepted)]

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Sum of weights per hundred words, and the logarithm of the sum."""
        folded = fold(text or "")
        total = sum(weight for _, _, weight in self.hits(folded))
        return 100 * total / (folded.count(" ") + 1 + SMOOTHING), math.log1p(total)

    def score(self, text: str | None) -> float:
        density, amount = self.evidence(text)
        offset, by_density, by_amount = self.model.curve
        return _sigmoid(offset + by_density * density + by_amount * amount)


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label must not be learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, toxic) of at most ``size`` distinct texts per class, written once."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("_text", F.xxhash64("text"))
    # Only ids and hashes are shuffled; of copies the one with the smallest id stays.
    distinct = texts.select("doc_id", "_text").join(known, "doc_id").groupBy("_text", "toxic").agg(F.min("doc_id").alias("doc_id"))
    distinct = materialised(distinct, "known-texts")
    chosen = [
        sample_by_hash(distinct.where(F.col("toxic") == c), size, "_text").select("doc_id", "_text", "toxic") for c in (0, 1)
    ]
    # At most 2 * size rows, so every executor can hold them.
    both = F.broadcast(chosen[0].unionByName(chosen[1]))
    # Rows that repeat a chosen id and text come with it.
    once = texts.join(both, ["doc_id", "_text"]).dropDuplicates(["_text", "toxic"])
    return materialised(once.select("text", "toxic"), "labelled")


def units(word: str) -> list[str]:
    """What of a word may enter the lexicon: the word, and its beginnings (marked by ``*``)."""
    return [word, *[f"{word[:n]}*" for n in STEMS if n < len(word)]]


def _unit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences by class of each unit, and its texts by class."""
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            once = set()
            for word in _WORDS.findall(fold(text)):
                if not 2 < len(word) < 40:
                    continue
                for unit in units(word):
                    row = seen.setdefault(unit, [0, 0, 0, 0])
                    row[toxic] += 1
                    if unit not in once:
                        once.add(unit)
                        row[2 + toxic] += 1
        if not seen:
            continue
        yield pd.DataFrame({
            "unit": list(seen), "clean": [r[0] for r in seen.values()], "toxic": [r[1] for r in seen.values()],
            "clean_docs": [r[2] for r in seen.values()], "docs": [r[3] for r in seen.values()],
        })


def _surroundings(known: frozenset[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each unit of ``known`` and each left neighbour it has, one of the right neighbours; all as hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, int], tuple[int, int]] = {}
            for text in batch["text"]:
                words = ["", *_WORDS.findall(fold(text)), ""]
                for left, word, right in zip(words, words[1:], words[2:]):
                    for unit in units(word):
                        if unit in known:
                            at = unit, zlib.crc32(left.encode())
                            pair = zlib.crc32(f"{left} {right}".encode()), zlib.crc32(right.encode())
                            seen[at] = min(seen.get(at, pair), pair)
            if not seen:
                continue
            yield pd.DataFrame({
                "unit": [u for u, _ in seen], "left": [x for _, x in seen], "place": [p for p, _ in seen.values()], "right": [r for _, r in seen.values()],
            })

    return run


def _independent(texts: DataFrame, known: frozenset[str]) -> dict[str, int]:
    """How many surroundings each unit of ``known`` has of which no two share a neighbour.

    Every left neighbour chooses one right neighbour, by hash, and the chosen ones are counted. Copies with
    changes choose among the text's own neighbours: whatever their number, a place in it counts twice at most.
    """
    found = texts.mapInPandas(_surroundings(known), "unit string, left long, place long, right long")
    chosen = found.groupBy("unit", "left").agg(F.min_by("right", F.struct("place", "right")).alias("right"))
    return {r["unit"]: r["n"] for r in chosen.groupBy("unit").agg(F.count_distinct("right").alias("n")).collect()}


def _phrase_counts(words: frozenset[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Documents by class with each pair of neighbouring words of which one is in the lexicon."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found = _WORDS.findall(fold(text))
                known = [not words.isdisjoint(units(w)) for w in found]
                pairs = {f"{a} {b}" for a, b, x, y in zip(found, found[1:], known, known[1:]) if x or y}
                for pair in pairs:
                    seen.setdefault(pair, [0, 0])[toxic] += 1
            if not seen:
                continue
            yield pd.DataFrame({"phrase": list(seen), "clean": [r[0] for r in seen.values()], "toxic": [r[1] for r in seen.values()]})

    return run


def _evidence_bound(part: float) -> Column:
    """Chernoff's exponent for ``docs`` toxic of all texts with a unit, of which ``part`` are expected; 0 where there are no more."""
    toxic, clean = F.col("docs"), F.col("clean_docs")
    n = toxic + clean
    exponent = toxic * F.log(toxic / (n * part)) + F.when(clean > 0, clean * F.log(clean / (n * (1 - part)))).otherwise(0.0)
    return F.when(toxic > n * part, exponent).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Lexicon, exceptions and curve from the labelled rows that are not held out.

    Neither the number of words nor the part of texts they must be in depends on the sample's size, so rare
    words of a large one are learned too. What comes to the driver is bounded by the sample: the units that
    pass, ``EXCEPTIONS`` phrases and three numbers per sampled row. Without toxic rows to learn from, every score is 0.
    """
    sample = _sample(docs, labels, size)
    total = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    nothing = Model({}, (), (-60.0, 0.0, 0.0))
    if not toxic:
        return nothing
    sums = [F.sum(c).alias(c) for c in ("clean", "toxic", "clean_docs", "docs")]
    schema = "unit string, clean long, toxic long, clean_docs long, docs long"
    counts = sample.mapInPandas(_unit_counts, schema).groupBy("unit").agg(*sums)
    counts = materialised(counts.where(F.col("docs") >= MIN_DOCS), "units")
    length = sample.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()
    chars = {r["toxic"]: r["n"] + 1 for r in length}
    ratio = ((F.col("toxic") + 0.5) / chars[1]) / ((F.col("clean") + 0.5) / chars.get(0, chars[1]))
    part = chars[1] / (chars[1] + chars.get(0, chars[1]))
    likely = counts.where((ratio >= MIN_RATIO) & (_evidence_bound(part) >= MIN_EVIDENCE)).select("unit", F.log(ratio).alias("weight")).collect()
    places = _independent(sample.where("toxic = 1"), frozenset(r["unit"] for r in likely))
    weights = {r["unit"]: r["weight"] for r in sorted(likely) if places[r["unit"]] >= MIN_DOCS}
    if not weights:
        return nothing
    phrases = sample.mapInPandas(_phrase_counts(frozenset(weights)), "phrase string, clean long, toxic long").groupBy("phrase").agg(*sums[:2])
    often = ((F.col("toxic") + 0.5) / (toxic + 1)) < 0.5 * ((F.col("clean") + 0.5) / (clean + 1))
    phrases = phrases.where((F.col("clean") >= MIN_EXCEPTION_DOCS) & often).orderBy(F.desc("clean"), "phrase").limit(EXCEPTIONS)
    draft = Model(weights, tuple(r["phrase"] for r in phrases.collect()), (0.0, 0.0, 0.0))
    points = sample.select(evidence(draft).alias("e"), "toxic").select("e.*", "toxic").toPandas()
    return draft._replace(curve=curve(points[["density", "amount"]].to_numpy(), points["toxic"].to_numpy()))


def curve(x: np.ndarray, label: np.ndarray, ridge: float = 1e-4, steps: int = 100) -> tuple[float, float, float]:
    """Logistic curve by Newton steps; classes weigh the same, the ridge bounds a clean split."""
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    design = np.column_stack([np.ones(len(x)), x])
    at = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -60, 60)))
        slope = design.T @ (share * (p - label)) + ridge * at
        at = at - np.linalg.solve((design * (share * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(at)), slope)
    return tuple(float(v) for v in at)


def evidence(model: Model) -> Column:
    """Struct of each text's hits: their weight per hundred words, and its amount."""

    @F.pandas_udf("density double, amount double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)
        for batch in batches:
            yield pd.DataFrame([matcher.evidence(t) for t in batch], columns=["density", "amount"], dtype="float64")

    return run(whole_text())


def score(model: Model) -> Column:
    """Probability that a text is toxic; empty and null texts have the curve's value at no hits."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model)
        for batch in batches:
            yield pd.Series([matcher.score(t) for t in batch], dtype="float64")

    return run(whole_text())


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that are not toxic, in their own columns."""
    return docs.where(score(model) < 0.5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_toxicity": op8_toxicity}
