"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import let


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, the test of a match, and how far pattern, checksum and context words are trusted.

    Patterns are written so that Java's matcher needs no backtracking over a run: a run is tried at its start or where the
    last match ended (`\\G`), and repetition is possessive, so long runs cost linear time and no stack."""

    name: str
    pattern: str
    hint: str  # a text without a match of this short pattern has no span
    score: float
    context: str  # regular expression of words before or after a span that make it likelier
    checksum: float = 0.0
    base: bool = True


CONTEXT_GAIN, CONTEXT_CHARS, MIN_SCORE = 0.3, 48, 0.5
#: Matches that may begin or end within CONTEXT_CHARS characters: each takes two at least.
NEIGHBOURS = CONTEXT_CHARS // 2
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Letters of an account number stand for 10 to 35 in its checksum.
LETTER_VALUES = {chr(ord("A") + i): str(10 + i) for i in range(26)}
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "(?i)mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "(?i)(^|[^a-z])ip([^a-z]|$)|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.3, "(?i)card|visa|credit|karte|carte|tarjeta", 0.5),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "(?i)phone|call|tel|mobile|fax"),
    # added kinds: what pattern and checksum give stays below MIN_SCORE, so the words around a match decide
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])", "[A-Z]{2}[0-9]{2}", 0.1, "(?i)iban|bank|account|konto|compte|cuenta", 0.35, base=False),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "[0-9]-[0-9]{2}-[0-9]", 0.3, "(?i)(^|[^a-z])ssn([^a-z]|$)|social.security|tax.id|national.id", base=False),
)


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the mod-10 checksum."""
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
    doubled = lambda v, i: F.when(i % 2 == 0, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
    return F.when(F.length(digits).between(13, 19), F.aggregate(places, F.lit(0), lambda a, i: a + doubled(value(i), i)) % 10 == 0).otherwise(F.lit(False))


def _mod97(account: Column) -> Column:
    """Whether an account number of 15 to 34 characters leaves 1 modulo 97, with its first four characters moved to the end."""
    compact = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    value = F.create_map(*[F.lit(x) for kv in LETTER_VALUES.items() for x in kv])
    figures = F.array_join(F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(value, c), c)), "")
    rest = F.aggregate(F.filter(F.split(figures, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return F.when(F.length(compact).between(15, 34), rest == 1).otherwise(F.lit(False))


def _valid(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]+", "")
    tests = {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": _luhn(digits),
        "phone": F.length(digits).between(9, 15),
        "iban": _mod97(match),
        "ssn": ~match.rlike("^(000|666|9..)|-00-|-0000$"),
    }
    return tests[kind.name]


def _spans(text: Column, kind: Kind) -> Column:
    """Array of struct(kind, start, end, score, match) of the valid matches by start, in code points, end exclusive.

    Splitting by a pattern and finding all its matches cut a text at the same places, so running sums of the lengths of
    both are offsets; only valid matches are kept on the way. The characters around a match are put together from the pieces
    and matches next to it, so a long text isn't walked again for each of its matches."""
    span = "struct<kind:string,start:int,end:int,score:double,match:string>"
    none = F.array().cast(f"array<{span}>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def walk(between: Column) -> Column:
        def step(a: Column, m: Column) -> Column:
            start = a["at"] + F.length(between[a["i"]])
            end = start + F.length(m)
            i = a["i"]
            pieces = lambda first, last, pair: F.array_join(F.flatten(F.transform(F.sequence(first, last), pair)), "")
            before = pieces(F.greatest(i - NEIGHBOURS, F.lit(0)), i, lambda j: F.array(F.get(found, j - 1), F.get(between, j)))
            after = pieces(i + 1, i + 1 + NEIGHBOURS, lambda j: F.array(F.get(between, j), F.get(found, j)))
            near = F.concat_ws(" ", F.right(before, F.lit(CONTEXT_CHARS)), F.left(after, F.lit(CONTEXT_CHARS)))
            score = F.least(F.lit(kind.score + kind.checksum) + F.when(near.rlike(kind.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0)), F.lit(1.0))
            one = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"), m.alias("match"))
            kept = F.filter(F.array(one), lambda x: F.lit(True) if kind.base else x["score"] >= MIN_SCORE)
            return F.struct((i + 1).alias("i"), end.alias("at"), F.when(_valid(kind, m), F.concat(a["out"], kept)).otherwise(a["out"]).alias("out"))

        return F.aggregate(found, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])

    return F.when(text.rlike(kind.hint), let(F.split(text, kind.pattern, -1), walk)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Add an array of struct(kind, start, end, score, match): all spans, by kind as in KINDS, then by start.

    Base kinds (email, ip, card, phone) keep every match that passes its own test, whatever its score. Account numbers (iban,
    mod-97 checksum) and social security numbers (ssn, ranges in use) are added only where a word of their context stands
    within the CONTEXT_CHARS characters of the text before or after it, whatever other matches stand there: without one neither
    makes MIN_SCORE. Null or empty text: empty array.
    Spans of different kinds may overlap. Repeated rows: each by itself. Empty table: empty result. A column named like
    `into` is replaced; other columns pass through."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(into, F.concat(*[_spans(whole, k) for k in KINDS]))


def listed(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end, joined by commas."""
    names = [k.name for k in KINDS if k.base]
    chosen = F.filter(spans, lambda x: x["kind"].isin(names)) if base_only else spans
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """The score of each span in per cent, joined by commas, in the order of `listed`."""
    return F.array_join(F.transform(spans, lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",")
