"""Operator 2: quality rules, in DataFrame functions alone.

Base measures count words, symbols, repeated lines and repeated word windows. The method's verdict is distribution divergence: histograms of
character classes and of common words are compared with language references by Jensen-Shannon distance (base 2, so from 0 to 1). References are sums
over all documents of a language that are long enough; a document is held against the nearest one, because its label may be wrong. Documents
of fewer than `min_words` words are not judged by it: their histograms say too little.

Nulls: a null text has no words, and is not kept. A null or unknown language gives no reference but is judged like any other. Rows are independent; repeated
rows give repeated results; an empty table gives an empty one; other columns go along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import written

# The most common words of each language, as far as they have ASCII letters alone.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with his".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}
WORD_LIST = sorted({w for words in COMMON_WORDS.values() for w in words})
#: The greatest distances to the nearest reference that are fine.
MOST_CHARS, MOST_WORDS = 0.21, 0.33
SPACE = r"[\x20\x09-\x0D]"
#: Taken away one after the other; what is left is the class of all other characters.
CLASSES = [("lower", "[a-z]+"), ("space", rf"{SPACE}+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("mark", r"[\x21-\x7E]+")]


def with_histograms(rows: DataFrame) -> DataFrame:
    """Adds chars and common, arrays of counts by character class and by common word (and all other words), to rows with a column text."""
    rows = rows.withColumn("rest0", F.coalesce("text", F.lit("")))
    for k, (_, pattern) in enumerate(CLASSES):
        rows = rows.withColumn(f"rest{k + 1}", F.regexp_replace(f"rest{k}", pattern, ""))
    rest = [F.length(f"rest{k}") for k in range(len(CLASSES) + 1)]
    rows = rows.withColumns({
        "chars": F.array(*(a - b for a, b in zip(rest, rest[1:], strict=False)), rest[-1]),
        # Letters, white space and digits are gone by then.
        "n_symbols": F.length("rest4") - F.length(F.regexp_replace("rest4", "[#*$%&|<>]+", "")),
        "low": F.split(F.lower("rest0"), r"[\x20\x09-\x0D.,;:!?]+"),
    }).drop(*(f"rest{k}" for k in range(1, len(CLASSES) + 1)))
    # The common words of a text as a short string in which each is counted. Expressions over an array stay small whatever its length, unlike a column for each word.
    few = F.filter("low", lambda w: w.isin(*WORD_LIST))  # a hash set, once planned
    rows = rows.withColumn("few", F.concat(F.lit("|"), F.array_join(few, "||"), F.lit("|")))
    found = F.transform(F.array(*(F.lit(f"|{w}|") for w in WORD_LIST)), lambda w: ((F.octet_length("few") - F.octet_length(F.replace("few", w, F.lit("")))) / F.octet_length(w)).cast("int"))
    return rows.withColumn("common", found).drop("low", "few")


def with_words(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_dup_lines and n_repeat_words."""
    rows = rows.withColumn("words", F.array_remove(F.split("rest0", f"{SPACE}+"), ""))
    rows = rows.withColumns({"n_words": F.size("words"), "three": F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))})
    # Only texts with a window that comes again are looked at place by place.
    again = F.size(F.array_distinct("three")) < F.size("three")
    rows = rows.withColumn("places", F.when(again, F.array_sort(F.transform("three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, k: F.coalesce(F.get("places", k)["h"] == e["h"], F.lit(False))
    rows = rows.withColumn("starts", F.array_sort(F.transform(F.filter("places", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"])))
    covered = F.aggregate(F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("rest0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0)), "word_chars": F.length(F.array_join("words", "")), "lines": lines})
    return rows.withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).drop("words", "three", "places", "starts", "lines")


def histograms(docs: DataFrame) -> DataFrame:
    """lang, n_words, chars and common of documents."""
    rows = with_histograms(docs.where(F.col("lang").isin(*COMMON_WORDS)).select("lang", "text"))
    return rows.select("lang", F.size(F.array_remove(F.split("rest0", f"{SPACE}+"), "")).alias("n_words"), "chars", "common")


def references(rows: DataFrame, min_words: int) -> list[tuple[str, list[float], list[float]]]:
    """Language, share of each character class and of each common word, from lang, n_words, chars and common; a row for each language of COMMON_WORDS at most."""
    rows = rows.where(F.col("lang").isin(*COMMON_WORDS) & (F.col("n_words") >= min_words))
    sums = rows.groupBy("lang").agg(
        F.array(*(F.sum(F.get("chars", F.lit(k))) for k in range(len(CLASSES) + 1))).alias("chars"), F.array(*(F.sum(F.get("common", F.lit(k))) for k in range(len(WORD_LIST)))).alias("common"), F.sum("n_words").alias("total")
    )
    out = []
    for r in sorted(sums.collect(), key=lambda r: r.lang):
        all_chars = sum(r.chars)
        out.append((r.lang, [x / all_chars for x in r.chars], [x / r.total for x in r.common] + [max(0.0, 1 - sum(r.common) / r.total)]))
    return out


def distance(counts: Column, total: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram to reference shares. Where a count is 0 its term is the share, so all of them start from the sum of the shares, which is 1."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return p * F.log2(p / m) + F.when(q > 0, q * F.log2(q / m) - q).otherwise(0.0)

    terms = F.zip_with(counts, F.array(*map(F.lit, shares)), lambda c, q: F.when(c > 0, term(c / total, q)).otherwise(0.0))
    return F.sqrt(F.greatest((F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + sum(shares)) / 2, F.lit(0.0)))


def features(docs: DataFrame) -> DataFrame:
    """row (the whole input row) with the base measures and the histograms."""
    rows = with_words(with_histograms(docs.select(F.struct("*").alias("row"), F.col("text"))))
    return rows.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")


def judged(rows: DataFrame, known: list[tuple[str, list[float], list[float]]], min_words: int, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance (null for short texts, rounded), from features()."""
    total = F.aggregate("chars", F.lit(0), lambda a, x: a + x)
    rest = F.greatest(F.col("n_words") - F.aggregate("common", F.lit(0), lambda a, x: a + x), F.lit(0))
    rows = rows.withColumns({"total": F.greatest(total, F.lit(1)), "common": F.array_append("common", rest)})
    rows = rows.withColumn("total_words", F.greatest(F.aggregate("common", F.lit(0), lambda a, x: a + x), F.lit(1)))
    none = F.lit(None).cast("double")
    chars = [distance(F.col("chars"), F.col("total"), c) for _, c, _ in known]
    words = [distance(F.col("common"), F.col("total_words"), w) for _, _, w in known]
    near = lambda x: F.least(*x) if len(x) > 1 else x[0] if x else none
    rows = rows.withColumns({
        "char_distance": F.round(F.when(F.col("n_words") >= min_words, near(chars)), 6),
        "word_distance": F.round(F.when(F.col("n_words") >= min_words, near(words)), 6),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words").cast("long") > 50 * F.col("n_words").cast("long")),
    })
    far = ((F.col("char_distance") > most_chars) | (F.col("word_distance") > most_words))
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("row", *counts, "base_failed", "kept", "char_distance", "word_distance")


def rules(docs: DataFrame, min_words: int = 100) -> DataFrame:
    """doc_id with all measures and the verdict. The texts are read once: what the references need of them is kept in a table of counts."""
    counted = features(docs.select("doc_id", "lang", "text")).select(F.struct("row.doc_id", "row.lang").alias("row"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")
    counted = written(counted, "features")
    out = judged(counted, references(counted.select("row.lang", "n_words", "chars", "common"), min_words), min_words)
    return out.select("row.doc_id", *(c for c in out.columns if c != "row"))


def good(docs: DataFrame, min_words: int = 100) -> DataFrame:
    """The documents that the rules keep, with their columns. Read twice, first for the references, so that whole texts aren't shuffled or kept."""
    out = judged(features(docs), references(histograms(docs), min_words), min_words)
    # A filter would be pushed below the measures, and compute them once more for each use.
    return out.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")
