"""Text expressions: trimming, snippets, previews, core words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own list of English stop words; the specification names only a few of them.
STOP_WORDS = (
    "about after all also an and any are as at be because been before being between but by can could did do does for from had has have he her his how if in into is it its may more most no nor not of on only or other our out over she should so some such than that the their them then there these they this those to under until up was we were what when where which while who whom whose why will with would you your"
).split()


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; Spark's trim takes only spaces."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def snippet(c: Column, length: int) -> Column:
    """The first characters, with '...' if there are more; null stays null."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def preview(c: Column, length: int) -> Column:
    """White space collapsed, then cut with ' ...'."""
    flat = strip(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    return F.when(F.length(flat) > length, F.concat(F.rtrim(F.substring(flat, 1, length)), F.lit(" ..."))).otherwise(flat)


def evidence(knowledge: Column, context: Column) -> Column:
    """Knowledge if it is there and not empty, else the context, else ''."""
    return F.coalesce(F.nullif(knowledge, F.lit("")), context, F.lit(""))


def core_words(c: Column) -> Column:
    """The set of lower-case English words of two letters or more that are no stop words; null gives the empty set.

    The plain pattern cuts accented words; word boundaries would differ between engines.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def joined_documents(docs: Column, n: int = 3) -> Column:
    """The texts of the first n documents (array of struct with a field text), parted by blank lines."""
    return F.array_join(F.transform(F.slice(docs, 1, n), lambda d: d["text"]), "\n\n")


def percent(c: Column) -> Column:
    """A share as text for exports, two decimals."""
    return F.format_string("%.2f%%", c * 100)


def joined(items: Column, separator: str = " | ") -> Column:
    return F.array_join(items, separator)
