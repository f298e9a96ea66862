"""Quality rules: divergence of character-class and common-word histograms from language references. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut, let, words

#: Frequent function words of each supported language.
COMMON_WORDS = {
    "de": ("der", "die", "das", "und", "zu", "den", "von", "mit", "ein", "ist", "nicht", "auf"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "une", "du", "que", "pour", "en"),
}
#: Reference of rows whose language is null or has no list: pooled over all of them, with the first words of each list.
OTHER = "*"
OTHER_WORDS = ("der", "die", "das", "the", "of", "and", "de", "la", "que", "le", "et", "en")
#: Common words count in any case and with these signs around or in them.
POINTS = '[.,;:!?()"]+'
MIN_WORDS = 50
#: Limits of the Jensen-Shannon distance (base 2, 0 to 1): a constant plus what chance adds to a histogram of n words, as
#: noise / sqrt(n). Texts of fewer words are too short to judge by a histogram.
MAX_CHAR, CHAR_NOISE = 0.14, 0.6
MAX_WORD, WORD_NOISE = 0.15, 1.0
MIN_WORDS_COMPARED = 80
#: Up to so many different repeated windows are looked up one by one; beyond it, sorting finds their places.
FEW = 16


def _covered(starts: Column) -> Column:
    """Words that the three-word windows at these ascending places cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])


def _repeated(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more. Windows are compared by 64-bit hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    twice = lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1) == x))

    def sorted_places(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])
        return let(ranked, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: same(s, x, k)), lambda x: x["i"])))

    def count(h: Column, r: Column) -> Column:
        few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(r, x), i)), lambda i: i.isNotNull())
        return F.when(F.size(r) == 0, F.lit(0)).when(F.size(r) <= FEW, _covered(few)).otherwise(_covered(sorted_places(h)))

    each = let(windows, lambda h: let(let(F.sort_array(h), twice), lambda r: count(h, r)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(each)


def features(text: Column, language: Column) -> dict[str, Column]:
    """Columns of counts of a whole text (null: empty): the base counts, and histograms of character classes and of the language's common words."""
    text = F.coalesce(text, F.lit(""))
    total = F.length(text)
    without = {k: F.length(F.regexp_replace(text, p, "")) for k, p in (("space", r"[\x20\x09-\x0D]+"), ("symbol", r"[#*$%&|<>]+"), ("lower", r"\p{Ll}+"), ("upper", r"\p{Lu}+"), ("digit", r"[0-9]+"))}
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lists = {**COMMON_WORDS, OTHER: OTHER_WORDS}
    every = sorted({w for ws in lists.values() for w in ws})
    mine = F.lit(None).cast("array<string>")
    for k, ws in lists.items():
        mine = F.when(language == k, F.array(*map(F.lit, ws))).otherwise(mine)

    bare = words(F.regexp_replace(F.lower(text), POINTS, ""))

    def frequent(w: Column) -> Column:
        found = F.filter(bare, lambda x: x.isin(every))
        each = let(found, lambda f: F.transform(mine, lambda c: F.size(F.filter(f, lambda x: x == c)).cast("long")))
        return let(each, lambda e: F.concat(e, F.array(F.size(w) - F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x))))

    by_word = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"), frequent(w).alias("word_counts")))
    return {
        "total": total.cast("long"),
        "by_word": by_word,
        "word_chars": without["space"].cast("long"),
        "without": F.array(*without.values()).cast("array<long>"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null where either is null or sums to 0."""

    def shares(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v), lambda n: F.transform(x, lambda v: F.try_divide(v.cast("double"), n.cast("double"))))

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(shares(p), shares(q), lambda a, b: (part(a, b) + part(b, a)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(F.greatest(total, F.when(total.isNotNull(), F.lit(0.0))))


def quality_rules(docs: DataFrame, text: str = "text", language: str = "lang", max_char: float = MAX_CHAR, max_word: float = MAX_WORD, keep_text: bool = True) -> DataFrame:
    """Add the base counts, `char_distance`, `word_distance`, `base_failed` and `kept` to every row.

    A reference is the sum of the histograms of all rows of a language that pass the base rules, so junk is no norm: one row for each
    listed language and one for all others (null included), so five rows at most are broadcast. A row is kept unless it
    fails the base rules (under 50 words, over half of them in repeated windows) or, with MIN_WORDS_COMPARED words or more, lies
    farther from its reference than a limit. Null or empty text: zero counts, base_failed. Repeated rows and ids: each judged alone.
    Empty table: empty result. Columns named like the added ones are replaced; other extra columns pass through. Texts
    themselves are only carried on with `keep_text`, as the counts are checkpointed between the two passes."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    kept = [c for c in docs.columns if c not in added and (keep_text or c != text)]
    ref = F.when(F.col(language).isin(list(COMMON_WORDS)), F.col(language)).otherwise(F.lit(OTHER))
    rows = cut(docs.select(*[F.col(c) for c in kept], ref.alias("__r"), *[c.alias(f"__{k}") for k, c in features(F.col(text), ref).items()]))
    known = lambda i: F.col("__total") - F.col("__without")[i]  # noqa: E731  space, symbol, lower, upper, digit
    other = F.col("__total") - known(0) - known(1) - known(2) - known(3) - known(4)
    rows = rows.select(*kept, "__r", "__total", *[F.col(f"__by_word.{k}").alias(k) for k in ("n_words", "n_repeat_words")], F.col("__word_chars").alias("word_chars"), known(1).alias("n_symbols"), F.col("__n_dup_lines").alias("n_dup_lines"), F.array(*[known(i) for i in range(5)], other).alias("__chars"), F.col("__by_word.word_counts").alias("__words"))
    size = {"chars": 6, "words": 1 + len(OTHER_WORDS)}
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    summed = rows.filter(~failed).groupBy("__r").agg(*[F.array(*[F.sum(F.col(f"__{k}")[i]) for i in range(n)]).alias(f"__ref_{k}") for k, n in size.items()])
    both = rows.join(F.broadcast(summed), "__r", "left").withColumns({"char_distance": distance(F.col("__chars"), F.col("__ref_chars")), "word_distance": distance(F.col("__words"), F.col("__ref_words"))})
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    limit = lambda most, noise: F.lit(most) + F.lit(noise) / root
    far = (F.col("n_words") >= MIN_WORDS_COMPARED) & ((F.coalesce(F.col("char_distance"), F.lit(0.0)) > limit(max_char, CHAR_NOISE)) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > limit(max_word, WORD_NOISE)))
    return both.withColumns({"base_failed": failed, "kept": ~failed & ~far}).select(*kept, *added)
