"""Personal data: patterns propose spans, checksums and ranges confirm them, nearby words adjust the score.

Spans are found by splitting a text at a pattern and listing the pattern's matches: the lengths of both, added up, are
the positions in code points. Patterns have no nested open-ended repeats; a text is searched for a kind only if it holds
a character or run that the kind needs. Running sums go by blocks, and what stands around a span is taken from parts of
PART characters, so texts with very many spans take time about in proportion. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the base kinds in the order in which they are listed, then of the added kinds. Quantifiers
# are possessive where that changes no match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold to be searched for a kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{11,}[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
BASE = ("email", "ip", "card", "phone")

# Each kind's score without context, and words that raise it where they stand within NEAR characters.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|pay",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|taxpayer",
}
NEAR, RAISE, LEAST = 40, 0.2, 0.5
PART = 256


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine, kind: str = "int") -> Column:
    """array: values combined from the first to each, by blocks of about the root of their number. `combine` must be
    associative. An empty array gives an empty one."""
    none = F.expr(f"CAST(array() AS array<{kind}>)")

    def within(block: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(combine(F.get(acc, F.size(acc) - 1), x))))
        return F.aggregate(block, none, step)

    def of(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), side - 1), lambda b: within(F.slice(v, b * side + 1, side)))

        def joined(rows: Column) -> Column:
            ends = within(F.filter(F.transform(rows, lambda r: F.get(r, F.size(r) - 1)), lambda x: x.isNotNull()))
            moved = lambda before: F.transform(rows, lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda x: combine(F.get(before, i - 1), x))))
            return F.flatten(let(ends, moved))

        return F.when(F.size(v) == 0, none).otherwise(let(blocks, joined))

    return let(values, of)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that don't overlap, in code points, end exclusive."""

    def placed(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, v: F.char_length(p) + F.char_length(v))
        spans = lambda ends: F.zip_with(ends, found, lambda e, v: F.struct((e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")))
        return let(running(lengths, lambda a, b: a + b), spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def parts(text: Column) -> Column:
    """The text in parts of PART characters; `cut` takes what it needs from a few of them."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))


def cut(of: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive, not before start) of a text in parts."""
    first = F.floor(start / PART).cast("int")
    run = F.slice(of, first + 1, F.floor(end / PART).cast("int") - first + 1)
    return F.substring(F.array_join(run, ""), start - first * PART + 1, end - start)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where the digits pass: every second from the right doubled, digits of the products added."""
    at = F.split(F.reverse(number), "")
    each = F.transform(at, lambda d, i: F.when(i % 2 == 1, (2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10)).otherwise(d.cast("int")).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where the remainder is 1: first four characters last, letters as two digits."""
    compact = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (F.when(c.between("0", "9"), a * 10).otherwise(a * 100) + value(c)) % 97) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.char_length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(value, r"\."), lambda p: F.when(small(p), F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        n = digits(value)
        return F.when(F.char_length(n).between(13, 19), luhn(n)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~(value.startswith("000") | value.startswith("666") | value.startswith("9") | value.endswith("0000"))
    return F.lit(True)


def found(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value, score>>: a kind's confirmed spans of a score of LEAST or more."""
    none = F.expr("CAST(array() AS array<struct<start: int, end: int, value: string>>)")
    proposed = F.when(text.contains("@") if kind == "email" else text.rlike(NEEDS[kind]), located(text, PATTERNS[kind])).otherwise(none)
    good = F.filter(proposed, lambda s: confirmed(kind, s["value"]))

    def scored(spans: Column, of: Column) -> Column:
        around = lambda s: F.concat(cut(of, F.greatest(s["start"] - NEAR, F.lit(0)), s["start"]), F.lit(" "), cut(of, s["end"], s["end"] + NEAR))
        near = lambda s: F.lower(around(s)).rlike(rf"\b(?:{CONTEXT[kind]})")
        score = lambda s: F.lit(SCORES[kind]) + F.when(near(s), RAISE).otherwise(0.0)
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.least(score(s), F.lit(1.0)).alias("score")))

    held = let(good, lambda g: let(F.when(F.size(g) > 0, parts(text)).otherwise(F.expr("CAST(array() AS array<string>)")), lambda of: scored(g, of)))
    return F.filter(held, lambda s: s["score"] >= LEAST)


def detect(docs: DataFrame, keep: list[str], text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """Columns `keep` and spans (kind, start, end, value, score), by kind as listed, then start. Null text has none.
    Rows stand alone: repeated ones get equal results, an empty table none; a column named spans is replaced."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = [c for c in keep if c != "spans"]
    each = docs.select(*keep, *(found(whole, k).alias(f"__{k}") for k in kinds))
    return each.select(*keep, F.concat(*(f"__{k}" for k in kinds)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs with every span of text replaced by its kind in angle brackets; overlapping spans are one, of
    the kind that starts first. Null text stays null; other rows and columns stay as they are."""
    rows = detect(docs.select(F.struct("*").alias("doc"), text), ["doc"], text)
    body = F.col(f"doc.{text}").cast("string")

    def replaced(spans: Column) -> Column:  # in order of their starts
        def with_ends(upto: Column) -> Column:  # the furthest end of the spans so far
            before = lambda i: F.when(i == 0, 0).otherwise(F.get(upto, i - 1))
            clean = lambda of: F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(of, before(i), s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
            whole = lambda of: F.concat(F.array_join(clean(of), ""), cut(of, F.get(upto, F.size(upto) - 1), F.char_length(body)))
            return let(parts(body), whole)

        return let(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), with_ends)

    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = rows.withColumn("__new", F.when(F.size("spans") > 0, let(ordered, replaced)).otherwise(body))
    return rows.select(*(F.col("__new").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))


def digest(kinds: tuple[str, ...]) -> Column:
    chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
