"""Lists that were stored as text, and arrays of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A \xNN escape preceded by an even number of backslashes.
_HEX_ESCAPE = r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})"


def trim_brackets(text: Column) -> Column:
    """Remove any leading and trailing square brackets."""
    return F.btrim(text, F.lit("[]"))


def parse_list(text: Column) -> Column:
    """List text such as ``['rock', "rock 'n roll"]`` to an array of strings.

    Quoted lists are read as JSON with single quotes allowed, so commas and
    apostrophes inside an item survive.  Text without quotes is split at its
    commas.  Null stays null, ``[]`` gives an empty array.
    """
    json_text = F.when(
        text.contains("\\x"), F.regexp_replace(text, _HEX_ESCAPE, r"$1\\u00$2")
    ).otherwise(text)
    quoted = F.from_json(
        json_text, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"}
    )
    bare = F.trim(trim_brackets(F.trim(text)))
    unquoted = F.transform(F.split(bare, ","), lambda item: F.btrim(item, F.lit(" '\"")))
    return F.coalesce(quoted, F.filter(unquoted, lambda item: item != ""))


def parse_floats(text: Column) -> Column:
    """Number text such as ``[1. 0.91 ... 3.e-1]`` to an array of doubles.

    Marks that are no numbers are left out.  The dots of a shortened print go
    before the cast, which is slow on text that it cannot read.
    """
    body = F.trim(F.translate(F.replace(text, F.lit("..."), F.lit(" ")), "[],", "   "))
    items = F.filter(F.split(body, r"\s+"), lambda item: item != "")
    numbers = F.transform(items, lambda item: item.try_cast("double"))
    return F.filter(numbers, lambda number: number.isNotNull())


def clean_tokens(tokens: Column) -> Column:
    """Trim and lower-case every token."""
    return F.transform(tokens, lambda token: F.lower(F.trim(token)))


def first_listed(tokens: Column, vocabulary: list[str]) -> Column:
    """The first token that is in ``vocabulary``, in the row's own order; null if none."""
    known = F.array(*[F.lit(word) for word in vocabulary])
    return F.try_element_at(F.array_intersect(tokens, known), F.lit(1))


def overlap_pct(truth: Column, found: Column) -> Column:
    """Share of ``truth`` that is also in ``found``, in percent; 0 for an empty truth."""
    common = F.size(F.array_intersect(truth, found))
    return F.lit(100.0) * common / F.greatest(F.size(truth), F.lit(1))


def without(ids: Column, own: Column) -> Column:
    """``ids`` without the row's own id."""
    return F.filter(ids, lambda item: item != own)
