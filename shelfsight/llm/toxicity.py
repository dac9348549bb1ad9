"""Toxicity: logistic regression over words and word beginnings, regularised by counterfactual identity terms.

In labelled sentences identity terms are swapped for others of their group, and the squared change of the
sentence's score is added to the loss, so that naming a group does not move a score by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.bytewords import (
    ALNUM, FOLDED, mix, owners, prefix_sums, sliced, span_hashes, text_buffer, word_bounds, word_hashes,
)
from shelfsight.llm.labelled import held_out, training_sample
from shelfsight.workspace import written

#: Words that name groups of people, each with the others of its row as counterfactuals.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"), ("old", "young", "disabled"),
    ("femmes", "hommes", "filles"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer", "mädchen"),
    ("muslime", "christen", "juden"), ("mujeres", "hombres", "niñas"), ("musulmanes", "cristianos", "judíos"),
)

PREFIXES = (4, 5, 6, 7, 8)
LEVELS = (2, 3, 5)


@dataclass(frozen=True)
class ToxicitySettings:
    """At most ``sample`` labelled ids train the model on the ``features`` words and word beginnings that tell labels
    apart best, among those in ``least_texts`` sampled texts or more whose chi-squared statistic reaches
    ``least_statistic``. ``ridge`` and ``counterfactual`` weigh the penalties."""

    sample: int = 12_000
    features: int = 1_500
    least_texts: int = 5
    least_statistic: float = 15.0
    ridge: float = 2e-4
    counterfactual: float = 1.0
    steps: int = 300


@dataclass
class ToxicityModel:
    words: np.ndarray  # sorted features
    bases: np.ndarray  # their hashes without count, sorted
    weights: np.ndarray
    bias: float


def term_hashes(terms: list[str]) -> np.ndarray:
    return word_hashes(*text_buffer(pa.array(terms)), ALNUM, fold=True)[0]


#: Identity terms are features as whole words only, so that a swap moves no beginning and no count.
IDENTITY_HASHES = np.unique(term_hashes([t for group in IDENTITY_TERMS for t in group]))


def _names_group(hashes: np.ndarray) -> np.ndarray:
    place = np.searchsorted(IDENTITY_HASHES, hashes)
    return IDENTITY_HASHES[np.minimum(place, len(IDENTITY_HASHES) - 1)] == hashes


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word and of its beginnings of PREFIXES bytes, and the text of each. Identity terms give no
    beginnings."""
    starts, ends, first = word_bounds(data, at, ALNUM)
    who, sums = owners(first), prefix_sums(data, FOLDED)
    words = span_hashes(sums, starts, ends)
    hashes, texts = [words], [who]
    plain = ~_names_group(words)
    starts, ends, who = starts[plain], ends[plain], who[plain]
    for n in PREFIXES:
        longer = ends - starts > n
        hashes.append(mix(span_hashes(sums, starts[longer], starts[longer] + n)))
        texts.append(who[longer])
    return np.concatenate(hashes), np.concatenate(texts)


def counted(hashes: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, its hash without count, text): each distinct hash of a text, and once more for each of LEVELS that
    its count in the text reaches; identity terms once only."""
    order = np.lexsort((hashes, who))
    hashes, who = hashes[order], who[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(hashes)))
    base, text = hashes[at], who[at]
    count[_names_group(base)] = 1
    out = [(base, base, text)]
    for level in LEVELS:
        some = count >= level
        out.append((mix(base[some] + np.uint64(level)), base[some], text[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _place(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are known, and their places."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.searchsorted(known, hashes)
    place[place == len(known)] = 0
    hit = np.flatnonzero(known[place] == hashes)
    return hit, place[hit]


def present(data: np.ndarray, at: np.ndarray, known: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each known feature of each text."""
    hashes, who = features(data, at)
    some, _ = _place(bases, hashes)
    feature, _, text = counted(hashes[some], who[some])
    hit, place = _place(known, feature)
    return text[hit], place


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in sliced(batches, "text"):
        feature, base, text = counted(*features(*text_buffer(part.column(0))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(feature.astype(np.int64)), pa.array(base.astype(np.int64)), part.column(1).take(pa.array(text))],
            ["word", "base", "label"],
        )


def _chosen_words(sample: DataFrame, settings: ToxicitySettings) -> tuple[np.ndarray, np.ndarray]:
    """The features with the largest chi-squared statistic and all identity terms, and their hashes without count."""
    toxic, texts = sample.agg(F.sum("label"), F.count("*")).first()
    n, p = texts or 0, (toxic or 0) / max(texts, 1)
    counts = sample.select("text", F.col("label").cast("long")).mapInArrow(
        _distinct_words, "word long, base long, label long"
    )
    counts = counts.groupBy("word").agg(F.min("base").alias("base"), F.sum("label").alias("a"), F.count("*").alias("df"))
    counts = counts.where(F.col("df") >= settings.least_texts)
    gap = F.col("a") - F.col("df") * p
    statistic = F.round(gap * gap * n / (F.col("df") * (n - F.col("df") + 1) * max(p * (1 - p), 1e-9)), 6)
    counts = counts.withColumn("statistic", statistic).where(F.col("statistic") >= settings.least_statistic)
    best = counts.orderBy(F.desc("statistic"), "word").limit(settings.features).select("word", "base").toArrow()
    terms = term_hashes([t for group in IDENTITY_TERMS for t in group])
    found, bases = (best.column(c).to_numpy().astype(np.uint64) for c in ("word", "base"))
    return np.unique(np.concatenate([found, terms])), np.unique(np.concatenate([bases, terms]))


def counterfactuals(texts: list[str], known: np.ndarray, bases: np.ndarray) -> Counter:
    """(feature, other feature) of every swap of an identity term in every sentence that has one, counted. Where the
    sentence has the other already, the swap only takes the feature away; the other is then -1."""
    groups = [_place(known, term_hashes(list(group)))[1] for group in IDENTITY_TERMS]
    group_of = {int(f): g for g, members in enumerate(groups) for f in members}
    sentences = [s for text in texts for s in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if s]
    out: Counter = Counter()
    if sentences:
        who, feature = present(*text_buffer(pa.array(sentences)), known, bases)
        term = np.isin(feature, list(group_of))
        found = list(zip(who[term].tolist(), feature[term].tolist(), strict=True))
        both = set(found)
        for t, f in found:
            others = (int(other) for other in groups[group_of[f]] if other != f)
            out.update((f, -1 if (t, other) in both else other) for other in others)
    return out


def fit(
    rows: list[tuple[str, int]], known: np.ndarray, bases: np.ndarray, settings: ToxicitySettings = ToxicitySettings()
) -> ToxicityModel:
    """The model of a few labelled texts that are at hand."""
    texts = [t for t, _ in rows]
    who, feature = present(*text_buffer(pa.array(texts, pa.large_string())), known, bases)
    label = np.array([y for _, y in rows], float)
    return fit_features(who, feature, label, counterfactuals(texts, known, bases), known, bases, settings)


def fit_features(
    who: np.ndarray, feature: np.ndarray, label: np.ndarray, pairs: Counter, known: np.ndarray, bases: np.ndarray,
    settings: ToxicitySettings,
) -> ToxicityModel:
    """Minimises mean log loss + ridge + counterfactual penalty by Adam over the whole sample."""
    size = len(known)
    if not len(label) or label.min() == label.max():
        rate = (label.sum() + 0.5) / (len(label) + 1)
        return ToxicityModel(known, bases, np.zeros(size), float(np.log(rate / (1 - rate))))
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    swapped = b >= 0
    share = np.array(list(pairs.values()), float) / max(sum(pairs.values()), 1)
    x = np.zeros(size + 1)
    rate = label.mean()
    x[-1] = np.log(rate / (1 - rate))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, settings.steps + 1):
        z = np.bincount(who, x[feature], len(label)) + x[-1]
        residual = (1 / (1 + np.exp(-z)) - label) / len(label)
        gradient = np.append(np.bincount(feature, residual[who], size), residual.sum())
        gradient[:-1] += 2 * settings.ridge * x[:-1]
        change = 2 * settings.counterfactual * share * (x[a] - np.where(swapped, x[b], 0))
        gradient[:-1] += np.bincount(a, change, size) - np.bincount(b[swapped], change[swapped], size)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        x -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    return ToxicityModel(known, bases, x[:-1], float(x[-1]))


def train(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    sample = written(training_sample(docs, labels, "toxic", settings.sample), "toxic-sample")
    known, bases = _chosen_words(sample, settings)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            who, feature = present(*text_buffer(part.column(1)), known, bases)
            order = np.lexsort((feature, who))
            at = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=part.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, feature[order].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2)], ["doc_id", "features", "label"])

    def swaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for part in sliced(batches, "text"):
            for text in part.column(0).to_pylist():
                out.update(counterfactuals([text], known, bases))
        columns = [pa.array([p[k] for p in out], pa.int32()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(out.values()), pa.int64())], ["a", "b", "n"])

    # At most len(known) features of a text, and as many swaps as there are pairs of terms, reach the driver.
    given = sample.select("doc_id", "text", F.col("label").cast("double"))
    rows = given.mapInArrow(found, "doc_id long, features array<int>, label double").toArrow().sort_by("doc_id")
    pairs = sample.select("text").mapInArrow(swaps, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counted_pairs = Counter({(r.a, r.b): r.n for r in pairs.orderBy("a", "b").collect()})
    lists = rows["features"].combine_chunks()
    who = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
    label = rows["label"].to_numpy()
    return fit_features(who, lists.flatten().to_numpy(), label, counted_pairs, known, bases, settings)


def toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text; nothing else is read), learnt
    from ``labels`` (doc_id, toxic). A null or empty text gets the score of a text without known words. Without
    usable labels every score is 0.5. Repeated rows give repeated results; empty input gives empty output."""
    model = train(docs, labels, settings)
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.bases, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bases, weights, bias = sent.value
        for part in sliced(batches, "text"):
            who, feature = present(*text_buffer(part.column(2)), words, bases)
            score = 1 / (1 + np.exp(-(np.bincount(who, weights[feature], part.num_rows) + bias)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    given = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
