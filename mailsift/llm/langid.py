"""Language identification: the family first, then the languages within it."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import id_and_text, map_rows, with_ids
from mailsift.sources.scratch import land

#: Language families by ISO 639-1 code; a fixed table. Other codes are a family each.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro rm sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
    "malayo-polynesian": "id jv mg ms su tl",
    "bantu": "rw sn sw xh zu",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Bins of hashed byte n-grams of one to three bytes.
BINS = 2048
#: Labelled documents per language that the machines are fitted on, at most.
SAMPLE = 2000
HELD_OUT_OF = 5
UNKNOWN = "und"
_BLOCK = 1 << 20


def family_of(code: str) -> str:
    return _FAMILY_OF.get(code.split("-")[0].lower(), code)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams of a whole text, in lower case."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BINS, np.int64)
    # In blocks that overlap by two bytes, each counting the n-grams that begin in it.
    for start in range(0, len(data), _BLOCK):
        part = data[start : start + _BLOCK + 2].astype(np.uint32)
        grams = part.copy()
        for n in (1, 2, 3):
            if n > 1:
                grams = grams[: len(part) - n + 1] * np.uint32(256) + part[n - 1 :]
            hashed = (grams[:_BLOCK] + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(21)
            counts += np.bincount(hashed, minlength=BINS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts.astype(float)


def held_out(key: Column) -> Column:
    """True for documents that nothing is learned from; false for null ids, which are not either."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


@dataclass(frozen=True)
class Machine:
    """A linear support vector machine that tells two names apart."""

    first: str
    second: str
    weights: np.ndarray
    intercept: float

    def margin(self, x: np.ndarray) -> float:
        """Above zero for the first name."""
        return float(self.weights @ x) + self.intercept


@dataclass(frozen=True)
class Identifier:
    """Machines between families, and between the languages of each family."""

    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and how sure the machines are, between 0 and 1."""
        if not text or not self.families or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = _vote(sorted(self.families), self.between, x)
        language, surer = _vote(self.families[family], self.within[family], x)
        return language, sure * surer


def _vote(names: list[str], machines: list[Machine], x: np.ndarray) -> tuple[str, float]:
    """The name with the most duels won, ties by margin; its chance is its closest duel's."""
    if len(names) == 1:
        return names[0], 1.0
    won: dict[str, int] = defaultdict(int)
    margins: dict[str, list[float]] = defaultdict(list)
    for m in machines:
        margin = m.margin(x)
        won[m.first if margin > 0 else m.second] += 1
        margins[m.first].append(margin)
        margins[m.second].append(-margin)
    best = max(names, key=lambda n: (won[n], sum(margins[n]), n))
    return best, float(1 / (1 + np.exp(-2 * np.clip(min(margins[best]), -20, 20))))


# --- learning -----------------------------------------------------------------------


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """At most so many documents of each language that are not held out, by hash order.

    Expects ``id, text, lang``. A sketch counts the ids of each language; those whose hash
    lies below a little more than the share wanted are ranked, so a language of any size
    has a bounded number of ids in the task that ranks it. The chosen ids meet the texts by
    broadcast, and only texts of the sample are shuffled: rows that repeat an id in a
    language are one document, the one with the least text.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    # Ten standard deviations more than wanted, and a quarter for the sketch.
    enough = 1.25 * (per_language + 10 * per_language**0.5 + 50)
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"))
    shares = land(sizes.select("lang", (F.lit(enough) / F.col("n")).alias("share")), "language_shares")
    place = F.xxhash64("id").cast("double") / 2.0**64 + 0.5
    low = known.join(shares, "lang").filter(place < F.col("share")).select("lang", "id").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = low.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "id")
    ids = land(chosen.select("id").distinct(), "language_sample")
    found = with_ids(known.select("id", "text", "lang"), ids)
    return found.groupBy("id", "lang").agg(F.min("text").alias("text")).select("id", "text", "lang")


def _vectors(sample: DataFrame) -> DataFrame:
    def make():
        def row(lang, text):
            if text and any(map(str.isalpha, text)):
                yield lang, family_of(lang), features(text)

        return row

    arrays = map_rows(sample, ["lang", "text"], make, "lang string, family string, x array<double>")
    return land(arrays, "language_features").withColumn("x", array_to_vector("x"))


def _machine(vectors: DataFrame, column: str, first: str, second: str, sizes: dict[str, int]) -> Machine:
    is_first = F.col(column) == first
    # Either side weighs the same, however many documents it has.
    weight = F.when(is_first, 0.5 / sizes[first]).otherwise(0.5 / sizes[second]) * (sizes[first] + sizes[second])
    rows = vectors.filter(F.col(column).isin(first, second)).select(
        "x", is_first.cast("double").alias("y"), weight.alias("w")
    )
    svc = LinearSVC(
        featuresCol="x", labelCol="y", weightCol="w", standardization=False, regParam=1e-4, maxIter=30
    ).fit(rows)
    return Machine(first, second, svc.coefficients.toArray(), float(svc.intercept))


def learn(docs: DataFrame, per_language: int = SAMPLE) -> Identifier:
    """Fit one machine for every two families and every two languages of a family."""
    vectors = _vectors(labelled_sample(docs, per_language))
    sizes = {r.lang: r.n for r in vectors.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    families: dict[str, list[str]] = defaultdict(list)
    family_sizes: dict[str, int] = defaultdict(int)
    for lang in sorted(sizes):
        families[family_of(lang)].append(lang)
        family_sizes[family_of(lang)] += sizes[lang]
    between = [_machine(vectors, "family", a, b, family_sizes) for a, b in combinations(sorted(families), 2)]
    within = {
        family: [_machine(vectors, "lang", a, b, sizes) for a, b in combinations(langs, 2)]
        for family, langs in families.items()
    }
    return Identifier(dict(families), between, within)


def identify(
    docs: DataFrame, per_language: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Language of every whole text: ``doc_id, held_out, lang_pred, score``.

    Learns from a bounded sample (``per_language`` documents of each language) of the rows
    with a language whose id is not held out; whole texts count. First a family is chosen
    by duels of linear support vector machines between families, then a language by duels
    within it. ``score`` is the product of the chances of the closest duel of each step.
    Predictions see the text alone, in one pass without a shuffle.

    A null text, and one without a letter, is ``und`` with score 0; so is every text when
    there is nothing to learn from. With one language that one is always predicted.
    A null id is not held out, nor learned from. Repeated rows come out as they are and are
    learned from once; an
    empty table gives no rows; extra columns are not read.
    """
    rows = id_and_text(docs, key, text)
    identifier = learn(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def make():
        predict = shared.value.predict

        def row(i, value):
            yield i, *predict(value)

        return row

    out = map_rows(rows, ["id", "text"], make, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
