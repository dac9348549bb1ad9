"""Secrets in texts: fixed patterns, and random-looking strings found by character Markov models.

Two first-order models of characters, one of random strings and one of ordinary words and identifiers, are
trained from labelled samples; a run of token characters is a secret when its log-likelihood ratio is high.
Everything is built-in expressions; the trained table is a constant of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm.arrays import block_folds, running

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: Ordinary identifiers and numbers, labelled so, beside the words of the corpus.
IDENTIFIERS = (
    "get_user_by_identifier", "maximumRetryCount", "application/octet-stream", "src/main/resources/config",
    "DEFAULT_TIMEOUT_SECONDS", "connection_pool_size", "HttpServletRequestWrapper", "2023-01-01", "2024-12-31",
    "image-width-1024", "user-agent-string", "content-security-policy", "updateCustomerAddress", "0123456789",
    "1234567890123456", "4000000000000000", "====================", "--------------------", "____________________",
    "index-of-first-element", "README_BEFORE_INSTALL", "numberOfParallelTasks", "/usr/local/share/documentation",
)
#: Runs that mix letters and digits may be secrets that no pattern names: they are not labelled ordinary.
MIXED = r"(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
FIRST, SIZE = 32, 96  # printable ASCII


@dataclass(frozen=True)
class MarkovSettings:
    """``sample_docs`` documents, those of least hash, give the ordinary words; ``random_strings`` strings of each
    alphabet are drawn from SHA-256. A run is random if its ratio reaches ``total`` thousandths and
    ``per_step`` thousandths for each transition."""

    sample_docs: int = 2000
    random_strings: int = 3000
    total: int = 12_000
    per_step: int = 400


def _random_samples(spark: SparkSession, n: int) -> DataFrame:
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    return spark.range(n).select(
        F.explode(
            F.array(
                digest,
                F.regexp_replace(F.base64(F.unhex(digest)), "=", ""),
                F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")),
            )
        ).alias("word")
    )


def _transitions(words: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of (character, next character), both printable ASCII: at most SIZE * SIZE rows."""
    chars = words.select(F.split("word", "").alias("c")).where("size(c) > 1")
    pairs = chars.select(
        F.explode(F.expr("transform(sequence(0, size(c) - 2), i -> struct(ascii(c[i]) AS a, ascii(c[i + 1]) AS b))"))
    ).select("col.a", "col.b")
    last = FIRST + SIZE - 1
    counted = pairs.where(F.col("a").between(FIRST, last) & F.col("b").between(FIRST, last)).groupBy("a", "b").count()
    return {(r["a"], r["b"]): r["count"] for r in counted.collect()}


def log_ratios(docs: DataFrame, settings: MarkovSettings = MarkovSettings()) -> list[int]:
    """log P(next | character) of random strings minus that of ordinary words, in thousandths, for all pairs of
    printable characters, row by row."""
    spark = docs.sparkSession
    least = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_docs)
    sample = docs.join(F.broadcast(least), "doc_id", "left_semi")
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}|{MIXED}", " ")
    words = sample.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[\x21-\x7E]{2,}"), F.lit(0))).alias("word"))
    ordinary = _transitions(words.union(spark.createDataFrame([(w,) for w in IDENTIFIERS * 20], "word string")))
    random = _transitions(_random_samples(spark, settings.random_strings))

    out = []
    for a in range(FIRST, FIRST + SIZE):
        sums = [sum(model.get((a, b), 0) for b in range(FIRST, FIRST + SIZE)) for model in (random, ordinary)]
        for b in range(FIRST, FIRST + SIZE):
            p, q = ((model.get((a, b), 0) + 0.5) / (n + 0.5 * SIZE) for model, n in zip((random, ordinary), sums, strict=True))
            out.append(round(1000 * math.log(p / q)))
    return out


def _sql_text(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans(docs: DataFrame, ratios: list[int], settings: MarkovSettings = MarkovSettings()) -> DataFrame:
    """All columns of ``docs`` and ``found``: array of (start, kind, stop) in order, kind as an index of KINDS,
    places counted in code points of ``text`` (null: empty), stop exclusive."""
    text = "coalesce(text, '')"
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))
    frame = docs
    for kind, pattern in patterns.items():
        p = _sql_text(pattern)
        has = f"{text} rlike {p}" if kind != "access" else f"contains({text}, 'AKIA')"
        for suffix, value in (
            ("hit", f"regexp_extract_all({text}, {p}, 0)"), ("gap", f"split({text}, {p}, -1)"),
        ):
            frame = frame.withColumn(f"_{kind}_{suffix}", F.expr(f"CASE WHEN {has} THEN {value} ELSE array() END"))
    frame = frame.withColumn(
        "_assign_value",
        F.expr(f"CASE WHEN size(_assign_hit) > 0 THEN regexp_extract_all({text}, {_sql_text(ASSIGN)}, 2) ELSE array() END"),
    )
    for kind in KINDS:
        frame = frame.withColumn(
            f"_{kind}_len",
            F.expr(f"transform(_{kind}_hit, (m, i) -> char_length(_{kind}_gap[i]) + char_length(m))"),
        )
    for kind in KINDS:
        frame = frame.withColumn(f"_{kind}_sum", F.expr(block_folds(f"_{kind}_len", "s + t")))
    weights = f"CAST(split('{','.join(map(str, ratios))}', ',') AS ARRAY<INT>)"
    step = f"element_at({weights}, (ascii(x.c[k]) - {FIRST}) * {SIZE} + ascii(x.c[k + 1]) - {FIRST} + 1)"
    score = f"IF(size(x.c) < 2, 0, aggregate(sequence(0, greatest(size(x.c) - 2, 0)), 0, (s, k) -> s + {step}))"
    random = f"y.score >= {settings.total} AND y.score >= {settings.per_step} * y.steps"
    for rank, kind in enumerate(KINDS):
        stop = running(f"_{kind}_len", f"_{kind}_sum", "i", "s + t")
        made = f"transform(_{kind}_hit, (m, i) -> struct({stop} - char_length(m) AS start, {rank} AS kind, {stop} AS stop))"
        if kind == "assign":
            made = f"filter({made}, (x, i) -> char_length(_assign_value[i]) >= 6)"
        if kind == "markov":
            scored = (
                f"transform(transform(_markov_hit, (m, i) -> struct(split(m, '') AS c, i AS i)), x -> "
                f"struct({score} AS score, size(x.c) - 1 AS steps, x.i AS i))"
            )
            good = f"filter({scored}, y -> {random})"
            frame = frame.withColumn("_random", F.expr(good))
            one = running("_markov_len", "_markov_sum", "y.i", "s + t")
            made = (
                f"transform(_random, y -> struct({one} - char_length(_markov_hit[y.i]) AS start, "
                f"{rank} AS kind, {one} AS stop))"
            )
        frame = frame.withColumn(f"_{kind}", F.expr(made))
    base = "sort_array(concat(_assign, _access, _hex))"
    frame = frame.withColumn("_base", F.expr(base))
    # Runs that patterns' spans cover in part are cut at those spans, and their parts are scored. Everything is bound
    # to z once, since a filter on the result repeats a column's expression at each mention.
    one = running("z.len", "z.sum", "i", "s + t")
    runs = f"transform(z.hit, (m, i) -> struct({one} - char_length(m) AS start, {one} AS stop))"
    # Runs that are a pattern's span as a whole drop out first, by hash.
    unlike = f"array_except({runs}, transform(z.base, b -> struct(b.start AS start, b.stop AS stop)))"
    touching = "filter(z.base, b -> b.start < r.stop AND r.start < b.stop)"
    cut = (
        f"filter(transform({unlike}, r -> struct(r.start AS start, r.stop AS stop, {touching} AS inner)), "
        "r -> size(r.inner) > 0)"
    )
    begins = (
        "filter(array_distinct(concat(array(r.start), transform(r.inner, b -> b.stop))), "
        "s -> s < r.stop AND NOT exists(r.inner, b -> b.start <= s AND s < b.stop))"
    )
    end = "array_min(concat(array(r.stop), transform(filter(r.inner, b -> b.start > s), b -> b.start)))"
    part = f"struct(s AS start, {end} AS stop, exists(z.markov, m -> m.start = r.start) AS of_random)"
    parts = f"flatten(transform({cut}, r -> transform({begins}, s -> {part})))"
    chars = "split(substring(z.text, p.start + 1, p.stop - p.start), '')"
    scored = (
        f"transform(transform({parts}, p -> struct(p.start AS start, p.stop AS stop, p.of_random AS of_random, {chars} AS c)), "
        f"x -> struct(x.start AS start, x.stop AS stop, x.of_random AS of_random, {score} AS score, size(x.c) - 1 AS steps, "
        f"exists(x.c, l -> l rlike '[A-Za-z0-9]') AS worded))"
    )
    good = f"(y.steps >= 15 AND {random}) OR (y.of_random AND y.worded AND y.score >= {settings.per_step} * y.steps)"
    rest = f"transform(filter({scored}, y -> {good}), y -> struct(y.start AS start, {KINDS.index('markov')} AS kind, y.stop AS stop))"
    alone = "filter(z.markov, x -> NOT exists(z.base, b -> b.start < x.stop AND x.start < b.stop))"
    bound = (
        f"array(struct(_base AS base, _markov AS markov, _markov_hit AS hit, _markov_len AS len, _markov_sum AS sum, {text} AS text))"
    )
    whole = f"IF(size(z.base) = 0, z.markov, sort_array(concat(z.base, {alone}, {rest})))"
    # A generator is a boundary: a filter on ``found`` stays above it, where its expression would otherwise be put in
    # for every mention, and grow with each further use.
    return frame.select(*docs.columns, F.explode(F.expr(f"transform({bound}, z -> {whole})")).alias("found"))


def _written_out(which: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({which}, x -> concat({names}[x.kind], ':', x.start, ':', x.stop)), ',')"


def secret_scan(docs: DataFrame, settings: MarkovSettings = MarkovSettings()) -> DataFrame:
    """Spans of secrets in every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_assign, n_access, n_hex, n_markov, base_sha256 and spans (kind:start:stop by start, then
    kind). A null or empty text has no spans. Random strings are reported outside patterns' spans: of a run that
    such spans cover in part, the rest is listed where it is random by itself (16 characters or more), or where the
    whole run is random and the part reaches ``per_step``. Repeated rows give repeated results; the sample for training counts a doc_id once. Empty input, empty output.
    """
    given = docs.select(F.col("doc_id").cast("long"), "text")
    found = spans(given, log_ratios(given, settings), settings).select("doc_id", "found")
    counts = [
        F.expr(f"CAST(size(filter(found, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{kind}")
        for k, kind in enumerate(KINDS)
    ]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.expr(_written_out("filter(found, x -> x.kind < 3)")), 256).alias("base_sha256"),
        F.expr(_written_out("found")).alias("spans"),
    )


def masked(docs: DataFrame, mark: str = "[secret]", settings: MarkovSettings = MarkovSettings()) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans become one mark. Texts without a
    span, null ones included, stay as they are."""
    # The row goes along whole, so that no column of it clashes with those made here.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")
    frame = spans(rows, log_ratios(docs.select("doc_id", "text"), settings), settings).withColumnRenamed("found", "_found")
    frame = frame.withColumn("_stop", F.expr("transform(_found, x -> x.stop)"))
    fold = "greatest(s, t)"
    frame = frame.withColumn("_tops", F.expr(block_folds("_stop", fold)))
    reach = running("_stop", "_tops", "i - 1", fold)
    # A span that starts beyond all before it opens a mark; the text between marks runs from the reach before it.
    frame = frame.withColumn(
        "_open",
        F.expr(
            f"filter(transform(_found, (x, i) -> IF(i = 0, struct(x.start AS start, 0 AS since, true AS opens), "
            f"struct(x.start AS start, {reach} AS since, x.start > {reach} AS opens))), y -> y.opens)"
        ),
    )
    kept = "transform(_open, y -> substring(text, y.since + 1, y.start - y.since))"
    tail = "substring(text, array_max(_stop) + 1)"
    whole = f"concat(array_join({kept}, {mark!r}), {mark!r}, {tail})"
    clean = F.expr(f"array(CASE WHEN size(_found) > 0 THEN {whole} ELSE text END)")
    frame = frame.select("_row", F.explode(clean).alias("_clean"))
    return frame.select(*(F.col("_clean" if c == "text" else f"_row.`{c}`").alias(c) for c in docs.columns))
