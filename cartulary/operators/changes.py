"""New states of a table against old ones, and sorted text output."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both tables by key, the new one where both have it, and status: created, updated, kept or absent (only
    old). Both have the same columns, and no key twice."""
    values = [c for c in new.columns if c != key]
    before, after = F.struct(*values), F.struct(*values)
    both = old.select(key, before.alias("was")).join(new.select(key, after.alias("now")), key, "full")
    same = reduce(lambda a, b: a & b, (F.col(f"was.`{c}`").eqNullSafe(F.col(f"now.`{c}`")) for c in values), F.lit(True))
    status = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "absent").when(same, "kept").otherwise("updated")
    return both.select(key, F.coalesce("now", "was").alias("row"), status.alias("status")).select(key, "row.*", "status")


def without_missing(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The old rows whose key is among ids: what is left when missing rows are deleted."""
    return old.join(ids.select(key).distinct(), key, "left_semi")


def write_csv(report: DataFrame, path: str, *order: str) -> None:
    """Semicolon-separated UTF-8 with a header, in order from part to part: sorted by ranges, not in one task."""
    report.orderBy(*order).write.option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)


def page(rows: DataFrame, order: list[str], asked: str | int | None, size: int = 50) -> DataFrame:
    """One page of rows in order: what is no number means the first page, one beyond the end (or below 1) the last."""
    text = str(asked).strip()
    last = max(1, -(-rows.count() // size))
    number = int(text) if text.lstrip("-").isdigit() else 1
    number = number if 1 <= number <= last else last
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def searched(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which one of the columns holds the text, in any case; % and _ stand for themselves."""
    return rows.where(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lower(F.lit(text))) for c in columns)))


#: Words of pages that sites show instead of what was asked for.
BLOCKED = ("captcha", "just a moment", "access denied", "cloudflare")


def fetch_status(code: Column, html: Column) -> Column:
    """What a fetched page is: missing (404 or no text), blocked (403, or a challenge's words in its first part), ok."""
    head = F.lower(F.substring(html, 1, 4000))
    challenged = reduce(lambda a, b: a | b, (F.contains(head, F.lit(w)) for w in BLOCKED))
    return F.when((code == 404) | html.isNull(), "missing").when((code == 403) | challenged, "blocked").otherwise("ok")
