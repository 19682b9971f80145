"""Text and number functions as columns."""

import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folds() -> tuple[str, str, str, dict[str, str]]:
    """Characters that decompose (NFKD, marks dropped) to one other, those others, characters that are marks, and those
    that decompose to several or none. Hangul syllables, which decompose to jamo, are left as they are."""
    one, to, marks, many = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one.append(c)
            to.append(plain)
        elif plain != c:
            many[c] = plain
    return "".join(one), "".join(to), "".join(marks), many


_ONE, _TO, _MARKS, _MANY = _folds()


def folded(text: Column) -> Column:
    """Compatibility decomposition without marks: 'Şırnak ﬁ' becomes 'Sırnak fi'. ASCII texts stay as they are."""
    known = F.from_json(F.lit(json.dumps(_MANY)), "map<string,string>")  # folded to a literal
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    plain = F.translate(F.when(F.translate(text, "".join(_MANY), "") != text, spelt).otherwise(text), _ONE + _MARKS, _TO)
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


def normalised(text: Column) -> Column:
    """Lower case without marks, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(folded(text)), r"\s+", " "))


def casefolded(text: Column) -> Column:
    """As normalised, for comparing: sharp s counts as ss, final sigma as sigma. Other foldings of Unicode that neither
    decomposition nor lower case gives (Cherokee, some Greek with iota below) are left out."""
    return F.translate(F.replace(normalised(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


def slug(text: Column, longest: int = 64) -> Column:
    """Letters and digits joined by hyphens, stripped of hyphens and then cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(folded(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)


def locale_number(text: Column) -> Column:
    """The last of comma and dot is the decimal sign; commas alone part thousands if three digits follow the last."""
    bare = F.regexp_replace(text, r"[^0-9.,\-]", "")
    comma, dot = F.instr(F.reverse(bare), ","), F.instr(F.reverse(bare), ".")
    both = F.when(comma < dot, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    alone = F.when(comma == 4, F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    return F.when((comma > 0) & (dot > 0), both).when(comma > 0, alone).otherwise(bare).try_cast("double")


def decimal_of(text: Column, precision: int = 12, scale: int = 2) -> Column:
    """A decimal, null where the text is none."""
    return F.nullif(F.trim(text), F.lit("")).try_cast(f"decimal({precision},{scale})")


def date_of(text: Column) -> Column:
    """The date of an ISO text's first ten characters; null where there is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).try_cast("date")


def fixed(value: Column, places: int = 2) -> Column:
    """The number with so many decimals, no grouping; ties are rounded half up."""
    return value.cast(f"decimal(38,{places})").cast("string")


def composite_id(*parts: Column, sign: str = "_") -> Column:
    """The parts joined by sign; null if one is."""
    return F.concat(parts[0], *(x for p in parts[1:] for x in (F.lit(sign), p)))


def year(text: Column) -> Column:
    """The year of an ISO date, else the first four digits in a row."""
    return F.coalesce(F.year(F.substring(text, 1, 10).try_cast("date")), F.regexp_extract(text, r"(\d{4})", 1).try_cast("int"))


def percentage(value: Column, total: Column) -> Column:
    return F.round(value.cast("double") / F.nullif(total, F.lit(0)).cast("double") * 100, 2)
