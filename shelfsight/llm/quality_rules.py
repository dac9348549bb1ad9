"""Quality rules: counts with fixed limits, and divergence from language references.

Each text's histogram of character classes and its histogram of common words are compared with the mean
histograms of its declared language, by Jensen-Shannon distance (base 2, so 0 to 1). Everything is built-in
expressions: one pass over the texts writes a few numbers per text, the rest works on those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.workspace import written

#: Frequent function words per language, in lower case.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "as", "on", "be", "by", "this",
           "from", "or", "an", "are"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "pour", "par", "sur",
           "au", "avec", "est", "il"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem",
           "nicht", "ein", "eine", "als", "auch"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su",
           "para", "es", "al"],
}
CHARACTER_CLASSES = ("lower", "upper", "digit", "beyond_ascii", "sentence", "symbol", "space")
GAP = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Limits:
    """``character`` and ``word`` + ``word_slack`` / sqrt(words) are the largest distances that pass; the slack is
    what chance adds in a short text. Texts below ``min_chars`` characters or ``min_words`` words are not judged
    by the respective distance. Limits are absolute, so a text's verdict changes with the corpus only through
    the reference histograms."""

    min_words_kept: int = 50
    max_repeat_percent: int = 50
    min_chars: int = 200
    min_words: int = 50
    character: float = 0.30
    word: float = 0.12
    word_slack: float = 1.8


def _histogram(counts: str, total: str) -> str:
    return f"transform({counts}, c -> c / greatest({total}, 1))"


def text_features(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, text_hash, base counts, ``characters`` (counts by class) and
    ``common`` (counts of the declared language's common words, then of all other words)."""
    text = F.coalesce("text", F.lit(""))
    first = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("text"))
    forms = sorted({f for words in COMMON_WORDS.values() for w in words for f in (w, w.capitalize(), w.upper())})
    listed = ", ".join(f"'{f}'" for f in forms)
    lists = "map(" + ", ".join(
        f"'{lang}', array({', '.join(repr(w) for w in words)})" for lang, words in COMMON_WORDS.items()
    ) + ")"
    split = first.select(
        "doc_id", "lang", F.xxhash64("text").alias("text_hash"),
        F.expr(f"filter(split(text, r'{GAP}+'), w -> w != '')").alias("words"),
        F.expr(rf"filter(split(text, '\n', -1), l -> l rlike r'[^\x20\x09-\x0D]')").alias("lines"),
        F.regexp_replace("text", "[a-z]+", "").alias("rest"),
        F.char_length("text").alias("n_chars"),
    )
    # Windows as (hash, place), in order of hash; places whose window occurs again are checked word by word.
    windows = split.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.expr(
            "CASE WHEN size(words) >= 4 THEN sort_array(transform(sequence(0, size(words) - 3), i -> struct("
            "xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i))) ELSE array() END"
        ).alias("windows"),
        F.expr(f"sort_array(transform(filter(words, w -> w IN ({listed})), w -> lower(w)))").alias("found"),
        F.regexp_replace("rest", "[A-Z]+", "").alias("rest2"),
    )
    same = (
        "words[x.i] = words[windows[{0}].i] AND words[x.i + 1] = words[windows[{0}].i + 1] "
        "AND words[x.i + 2] = words[windows[{0}].i + 2]"
    )
    repeated = (
        "array_sort(transform(filter(windows, (x, k) -> "
        f"(k > 0 AND x.h = windows[k - 1].h AND {same.format('k - 1')}) OR "
        f"(k + 1 < size(windows) AND x.h = windows[k + 1].h AND {same.format('k + 1')})), x -> x.i))"
    )
    counted = windows.select(
        "doc_id", "lang", "text_hash", "n_chars", "n_words", "rest2", "found",
        F.expr("aggregate(words, 0L, (n, w) -> n + char_length(w))").alias("word_chars"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr(repeated).alias("repeated"),
        F.expr("char_length(rest) - char_length(rest2)").alias("upper"),
        F.expr("n_chars - char_length(rest)").alias("lower"),
        F.expr(rf"char_length(rest2) - char_length(regexp_replace(rest2, r'[\x80-\x{{10FFFF}}]+', ''))").alias("beyond"),
        F.expr("char_length(rest2) - char_length(regexp_replace(rest2, '[0-9]+', ''))").alias("digit"),
        F.expr(r"char_length(regexp_replace(rest2, '[^.,;:?]+', ''))").alias("sentence"),
        F.expr(r"char_length(regexp_replace(rest2, '[^#*$%&|<>]+', ''))").cast("long").alias("n_symbols"),
        F.expr(f"{lists}[lang]").alias("list"),
    )
    space = F.expr("n_chars - word_chars")
    symbol = F.expr("word_chars - lower - upper - digit - beyond - sentence")
    sizes = F.expr("transform(list, w -> size(filter(found, f -> f = w)))")
    return counted.select(
        "doc_id", "lang", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(
            "CASE WHEN size(repeated) = 0 THEN 0L ELSE aggregate(sequence(0, size(repeated) - 1), 0L, (n, k) -> n + "
            "least(3, coalesce(try_element_at(repeated, k + 2), repeated[k] + 3) - repeated[k])) END"
        ).alias("n_repeat_words"),
        F.array("lower", "upper", "digit", "beyond", "sentence", symbol, space).alias("characters"),
        "n_chars", sizes.alias("listed"),
    ).withColumn(
        "common",
        F.expr("concat(listed, array(CAST(n_words - aggregate(listed, 0, (n, c) -> n + c) AS INT)))"),
    ).drop("listed")


def references(features: DataFrame, limits: Limits) -> DataFrame:
    """(lang, character_reference, word_reference): mean histograms of every language that has texts long enough to
    be judged; word_reference is null for languages without COMMON_WORDS. Histograms are summed in whole millionths,
    so the result does not depend on the order of rows."""
    usable = features.where(
        F.col("lang").isNotNull() & (F.col("n_chars") >= limits.min_chars) & (F.col("n_words") >= limits.min_words)
    )
    sizes = {"characters": len(CHARACTER_CLASSES), "common": len(COMMON_WORDS["en"]) + 1}
    sums = [
        F.sum(F.expr(f"CAST(round(1e6 * {column}[{i}] / {total}) AS BIGINT)")).alias(f"{column}{i}")
        for column, total in (("characters", "n_chars"), ("common", "n_words"))
        for i in range(sizes[column])
    ]

    def shares(column: str):
        listed = [f"{column}{i}" for i in range(sizes[column])]
        all_ = " + ".join(listed)
        return F.expr(f"CASE WHEN {all_} IS NOT NULL THEN array({', '.join(f'{v} / greatest({all_}, 1)' for v in listed)}) END")

    return usable.groupBy("lang").agg(*sums).select(
        "lang", shares("characters").alias("character_reference"), shares("common").alias("word_reference")
    )


def distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of the histogram expression ``p`` from the expression ``q``."""
    term = "IF({0} > 0, {0} * log2({0} / ((x + y) / 2)), 0D)"
    summed = f"aggregate(zip_with({p}, {q}, (x, y) -> ({term.format('x')} + {term.format('y')}) / 2), 0D, (s, t) -> s + t)"
    return f"round(sqrt(greatest({summed}, 0D)), 9)"


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (doc_id, text, lang; other columns are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, the two
    distances and text_hash. A null text has no words and so fails the base. Every language with texts long enough
    has a character reference. A text whose language is null or has no reference has no distances and is judged by
    the base alone, and so are the words of languages without COMMON_WORDS. Repeated rows give repeated results.
    """
    counted = written(text_features(docs), "quality")
    # Written, a few rows are seen to be few, and the texts are not shuffled by language.
    features = counted.join(written(references(counted, limits), "references"), "lang", "left")
    by_character = F.expr(distance(_histogram("characters", "n_chars"), "character_reference"))
    by_word = F.expr(distance(_histogram("common", "n_words"), "word_reference"))
    by_character = F.when(F.col("character_reference").isNotNull(), by_character)
    by_word = F.when(F.col("word_reference").isNotNull(), by_word)
    failed = (F.col("n_words") < limits.min_words_kept) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )
    odd = (
        ((F.col("n_chars") >= limits.min_chars) & (F.col("character_distance") > limits.character))
        | (
            (F.col("n_words") >= limits.min_words)
            & (F.col("word_distance") > limits.word + limits.word_slack / F.sqrt("n_words"))
        )
    )
    return (
        features.withColumn("character_distance", by_character).withColumn("word_distance", by_word)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
        .select(
            "doc_id", "n_words", F.col("word_chars").cast("long"), "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "character_distance", "word_distance", "text_hash",
        )
    )
