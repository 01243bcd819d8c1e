"""Quality rules: distribution divergence from language references. DataFrame functions only.

A document's histogram of character classes and its histogram of common words
are compared with those of its language by Jensen-Shannon distance (square
root of the divergence in bits, 0 to 1). The references are sums over all
documents of a language that pass the base rules, so they follow the corpus.
Short texts have noisy histograms: each distance counts only from a least
length on.

Defined cases: a null or blank text has no words and fails the base rules. A
document whose ``lang`` is null or unknown is compared with the language whose
common words it has most of (ties: the first of ``COMMON_WORDS``). A language
without any document that passes the base rules has no reference, and its
distances are null, which rejects nothing. Equal rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.llm.common import WHITE_SPACE_CLASS, Scratch, let, words

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with his they at be this have from or by".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero".split(),
}
# Character classes; white space, symbols and all other characters follow them.
CHAR_CLASSES = {
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "stop": r"[.,;:!?'\"()\-]+",
    "wide": r"[^\x00-\x7F]+",
}
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Base rules and the method's thresholds."""

    least_words: int = 20
    repeat_percent: int = 30
    class_distance: float = 0.25
    class_least_chars: int = 300
    word_distance: float = 0.28
    word_least_words: int = 100


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeat_words(tokens: Column) -> Column:
    """Words in windows of 8 words that are found twice or more in the text, the first included.

    Windows are compared by 64-bit hash. Sorting (hash, position) puts equal
    windows side by side, so the cost is n log n for any text.
    """
    def covered(at: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.least(F.lit(WINDOW), at[k] - at[k - 1]))
        inner = F.when(F.size(at) > 1, F.aggregate(steps, F.lit(0), lambda a, b: a + b)).otherwise(0)
        return (inner + WINDOW).cast("long")

    def repeated(ranked: Column) -> Column:
        last = F.size(ranked) - 1

        def twin(j: Column) -> Column:
            return ((j > 0) & (ranked[j]["h"] == ranked[F.greatest(j - 1, F.lit(0))]["h"])) | \
                ((j < last) & (ranked[j]["h"] == ranked[F.least(j + 1, last)]["h"]))
        at = F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda j: ranked[j]["i"])
        return let(F.sort_array(at), covered)

    def over(windows: Column) -> Column:
        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")) \
            .otherwise(let(F.sort_array(pairs), repeated))

    def hashed(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                              lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))
        return let(windows, over)

    return F.when(F.size(tokens) < WINDOW, F.lit(0).cast("long")) \
        .otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), hashed))


def base_signals(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, lang, text, tokens, lines and the base columns of each document."""
    has_word = r"[^\x20\x09-\x0D]"
    df = df.select("doc_id", F.col("lang").cast("string").alias("lang"),
                   F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("tokens", words(F.col("text"))) \
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(has_word)))
    df = df.withColumns({
        "n_words": F.size("tokens").cast("long"),
        "word_chars": F.length(F.array_join("tokens", "")).cast("long"),
        "n_symbols": _count(F.col("text"), SYMBOLS),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("tokens")),
    })
    failed = (F.col("n_words") < limits.least_words) | \
        (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _histograms(df: DataFrame) -> DataFrame:
    """Adds ref_lang, the class counts and the common-word counts (last entry: other words)."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    lowered = F.transform("tokens", lambda w: F.lower(w))
    df = df.withColumn("common", F.filter(lowered, lambda w: w.isin(every)))
    hits = F.array(*[F.struct(F.size(F.filter("common", lambda w, ws=ws: w.isin(ws))).alias("n"), F.lit(-i).alias("i"))
                     for i, ws in enumerate(COMMON_WORDS.values())])
    names = F.array(*[F.lit(k) for k in COMMON_WORDS])
    best = let(F.array_max(hits), lambda x: names[-x["i"]])
    df = df.withColumn("ref_lang", F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(best))
    size, text = F.length("text").cast("long"), F.col("text")
    classes = [_count(text, p) for p in CHAR_CLASSES.values()] + [size - F.col("word_chars"), F.col("n_symbols")]
    df = df.withColumn("known_classes", F.array(*classes))
    rest = size - F.aggregate("known_classes", F.lit(0).cast("long"), lambda a, b: a + b)
    df = df.withColumn("class_counts", F.concat("known_classes", F.array(rest)))
    vocabulary = F.lit(None).cast("array<string>")
    for lang, ws in COMMON_WORDS.items():
        vocabulary = F.when(F.col("ref_lang") == lang, F.array(*[F.lit(w) for w in ws])).otherwise(vocabulary)

    def per_word(common: Column) -> Column:
        return F.transform(vocabulary, lambda v: (F.size(common) - F.size(F.array_remove(common, v))).cast("long"))
    df = df.withColumn("known_words", let(F.col("common"), per_word))
    other = F.col("n_words") - F.aggregate("known_words", F.lit(0).cast("long"), lambda a, b: a + b)
    return df.withColumn("word_counts", F.concat("known_words", F.array(other)))


def js_distance(counts: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if either is empty."""
    total = sum(reference)
    if not total:
        return F.lit(None).cast("double")
    q = F.array(*[F.lit(x / total) for x in reference])

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of(n: Column) -> Column:
        terms = F.zip_with(F.transform(counts, lambda c: c / n), q,
                           lambda p, r: part(p, (p + r) / 2) + part(r, (p + r) / 2))
        divergence = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2
        return F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0)))
    return let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b), lambda n: F.when(n > 0, of(n)))


def language_references(signals: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Histograms of each language over all documents that pass the base rules.

    One row per language of ``COMMON_WORDS`` reaches the driver, a fixed number.
    """
    n_classes = len(CHAR_CLASSES) + 3
    n_words = len(next(iter(COMMON_WORDS.values()))) + 1
    sums = [F.sum(F.col("class_counts")[i]).alias(f"c{i}") for i in range(n_classes)] + \
        [F.sum(F.col("word_counts")[i]).alias(f"w{i}") for i in range(n_words)]
    found = signals.filter(~F.col("base_failed")).groupBy("ref_lang").agg(*sums).collect()
    out = {r["ref_lang"]: ([int(r[f"c{i}"]) for i in range(n_classes)], [int(r[f"w{i}"]) for i in range(n_words)])
           for r in found}
    return {lang: out.get(lang, ([0] * n_classes, [0] * n_words)) for lang in COMMON_WORDS}


def divergence_rules(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: base columns, both distances, failed rules and ``kept``.

    ``df`` needs doc_id, text and lang; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "divergence")
    signals = _histograms(base_signals(df, limits)).select(
        "doc_id", "ref_lang", F.length("text").cast("long").alias("n_text_chars"), "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", "class_counts", "word_counts")
    signals = scratch.write(signals, "signals")
    references = language_references(signals)
    by_class, by_word = F.lit(None).cast("double"), F.lit(None).cast("double")
    for lang, (classes, common) in references.items():
        by_class = F.when(F.col("ref_lang") == lang, js_distance(F.col("class_counts"), classes)).otherwise(by_class)
        by_word = F.when(F.col("ref_lang") == lang, js_distance(F.col("word_counts"), common)).otherwise(by_word)
    out = signals.withColumn("class_distance", F.round(by_class, 6)).withColumn("word_distance", F.round(by_word, 6))
    far_class = (F.col("n_text_chars") >= limits.class_least_chars) & (F.col("class_distance") > limits.class_distance)
    far_word = (F.col("n_words") >= limits.word_least_words) & (F.col("word_distance") > limits.word_distance)
    rules = {"class_divergence": far_class, "word_divergence": far_word}
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return out.withColumn("failed_rules", failed) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)) \
        .drop("class_counts", "word_counts", "n_text_chars")
