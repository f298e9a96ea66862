"""Secret scan: patterns for well-known shapes, and sliding-window entropy of candidate strings with an allow-list."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))

#: Base kinds, in the order that breaks ties of a start: pattern, group that is measured, least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}
#: The same matches of at least the least length; a shorter run is never a match of its own that a longer one could hide.
FAST_HEX = re.compile("[0-9a-f]{16,}")
ASSIGN_HINT = re.compile("passw|secret|token|api_?key", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile("[A-Za-z0-9]+")
ORDER = {k: i for i, k in enumerate([*BASE, "entropy"])}

#: Character classes, each with the alphabet it is drawn from; the classes of a window are those of its characters.
CLASSES = ("lower", "upper", "digit", "symbol")
_CLASS_OF = np.full(128, 3, dtype=np.int8)
_CLASS_OF[ord("a") : ord("z") + 1] = 0
_CLASS_OF[ord("A") : ord("Z") + 1] = 1
_CLASS_OF[ord("0") : ord("9") + 1] = 2


# Frequent pairs of letters in English, German, French and Spanish words.
COMMON_PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ch ge ie un be ic el ne li ss ei sc ue qu ai me la em ma co ro ta io us ll il "
    "ac ad am ca ce ci da di do ec ef el em ga ho ht ib ig ir iv ke ko lo lu mi mo na ni no nc om op os ot pa pe pl po pr ri rs rt ru sh so su tr ts tu ul um ut ve vi wa we wi".split()
)


@dataclass(frozen=True)
class Rules:
    """Window length in characters; least entropy in bits of the characters of each class inside a window, for classes with at
    least `least` characters there; how many classes must reach theirs. A letter class with `alone_least` characters suffices alone
    from `alone` bits. Capitals with digits and nothing else, as in upper-case hex, suffice where all characters of the window together
    have `capitals` bits, and letters of both cases with digits where they have `mixed`. `allow` spares whole candidates, the others only
    windows."""

    window: int = 20
    lower: float = 2.2
    upper: float = 2.2
    digit: float = 1.8
    symbol: float = 1.5
    least: int = 5
    classes: int = 2
    alone: float = 3.0
    alone_least: int = 12
    capitals: float = 3.0
    mixed: float = 3.7
    allow: tuple[str, ...] = (
        r"^[0-9]+(?:[-_/][0-9]+)*$",  # numbers and dates
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # public identifiers
    )
    #: Parts between signs that no window may touch; parts that are no secret if their letters pair as in words: words, words with
    #: a number, words in a row that each start with a capital, numbers.
    words: str = r"(?i:example|sample|placeholder|dummy|changeme|xxxx)"
    plain: str = r"[a-z]*(?:[A-Z][a-z]+)*[0-9]{0,6}|[A-Z]+[0-9]{0,6}|[0-9]+[a-z]?"
    #: Least share of COMMON_PAIRS among the pairs of letters of a window, where it has `pairs` or more.
    common: float = 0.3
    pairs: int = 8


def window_entropies(s: str, window: int) -> Iterator[tuple[int, list[int], list[float]]]:
    """(start, characters by class, entropy by class) of every window of an ASCII string.

    Counts change by one character in and one out, and with them n log2 n sums: constant work for each step."""
    codes = s.encode()
    log = [0.0] + [n * float(np.log2(n)) for n in range(1, window + 2)]  # a window holds one more while it moves
    counts, total, weight = [0] * 128, [0] * 4, [0.0] * 4
    for i, c in enumerate(codes):
        k = _CLASS_OF[c]
        weight[k] += log[counts[c] + 1] - log[counts[c]]
        counts[c] += 1
        total[k] += 1
        if i >= window:
            old = codes[i - window]
            k = _CLASS_OF[old]
            weight[k] += log[counts[old] - 1] - log[counts[old]]
            counts[old] -= 1
            total[k] -= 1
        if i >= window - 1:
            yield i - window + 1, total, [(log[n] - w) / n if n else 0.0 for n, w in zip(total, weight, strict=True)]


def scattered(total: list[int], bits: list[float], rules: Rules) -> bool:
    """Whether all characters of a window together reach the limit of capitals with digits, or of letters of both cases with digits:
    their entropy is that of the classes and, inside each, of its characters."""
    lower, upper, digit, symbol = total
    if symbol or upper < 3 or digit < (2 if lower else 5) or 0 < lower < 3:
        return False
    n = lower + upper + digit
    return sum(k / n * (b + math.log2(n / k)) for k, b in zip(total, bits, strict=True) if k) >= (rules.mixed if lower else rules.capitals)


def spared_windows(s: str, rules: Rules) -> Callable[[int, bool], bool]:
    """Whether the window from a place of a candidate touches a part with a word for examples, or holds nothing but plain parts whose
    letters pair as in words. With `wordy`, parts need not be plain where letters pair so. Constant work for each window."""
    n = len(s)
    word, odd, pairs, common = (np.zeros(n + 1, dtype=np.int64) for _ in range(4))
    for m in PART.finditer(s):
        word[m.start() + 1 : m.end() + 1] = re.search(rules.words, m.group()) is not None
        odd[m.start() + 1 : m.end() + 1] = re.fullmatch(rules.plain, m.group()) is None
    low = s.lower()
    for i in range(n - 1):
        if low[i].isalpha() and low[i + 1].isalpha():
            pairs[i + 1], common[i + 1] = 1, low[i : i + 2] in COMMON_PAIRS
    word, odd, pairs, common = (x.cumsum().tolist() for x in (word, odd, pairs, common))

    def spared(i: int, wordy: bool = False) -> bool:
        j = i + rules.window
        letters = pairs[j - 1] - pairs[i]
        as_words = letters >= rules.pairs and common[j - 1] - common[i] >= rules.common * letters
        return word[j] > word[i] or wordy and as_words or odd[j] == odd[i] and (letters < rules.pairs or as_words)

    return spared


def entropy_spans(text: str, rules: Rules, allowed: re.Pattern | None) -> list[tuple[str, int, int]]:
    """Unions of the windows of a candidate string that reach the limits, unless the allow-list knows the candidate or the window."""
    limits = (rules.lower, rules.upper, rules.digit, rules.symbol)
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if len(s) < rules.window or allowed is not None and allowed.search(s):
            continue
        start = end = -1
        spared = None
        for i, total, bits in window_entropies(s, rules.window):
            alone = any(n >= rules.alone_least and b >= rules.alone for n, b in zip(total[:2], bits[:2], strict=True))
            by_class = alone or sum(n >= rules.least and b >= x for n, b, x in zip(total, bits, limits, strict=True)) >= rules.classes
            if by_class or scattered(total, bits, rules):
                if allowed is not None:
                    spared = spared or spared_windows(s, rules)
                    if spared(i, not by_class):
                        continue
                if start >= 0 and i > end:
                    out.append(("entropy", m.start() + start, m.start() + end))
                    start = -1
                if start < 0:
                    start = i
                end = i + rules.window
        if start >= 0:
            out.append(("entropy", m.start() + start, m.start() + end))
    return out


def scan(text: str | None, rules: Rules = Rules(), allowed: re.Pattern | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a text in code points, by start, then kind in ORDER."""
    if not text:
        return []
    found = entropy_spans(text, rules, allowed)
    found += [("hex", m.start(), m.end()) for m in FAST_HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in BASE["access"][0].finditer(text) if m.end() - m.start() >= 18]
    if ASSIGN_HINT.search(text):
        pattern, group, least = BASE["assign"]
        found += [("assign", m.start(), m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", rules: Rules = Rules()) -> DataFrame:
    """Add an array of struct(kind, start, end) of the secrets in each whole text, by start, then kind.

    Base kinds are never suppressed; the entropy kind is what the allow-list leaves. Null or empty text: empty array.
    Kinds may overlap. Repeated rows: each by itself. Empty table: empty result. A column named like `into` is replaced;
    other columns pass through."""
    source = "|".join(f"(?:{x})" for x in rules.allow)

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        allowed = re.compile(source) if source else None
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, rules, allowed)] for t in texts])

    return docs.withColumn(into, spans(F.col(text)))
