"""Text cleaning, code words and free-text answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_col, paste

# A code word is two initials and a birth date.
CODE_PARTS = ("initials_mother", "initials_father", "yyyy", "mm", "dd")
NO_INITIALS = "XX"
EMPTY_CODE = "XX XX NA"
NON_ALNUM = r"[^\p{L}\p{N}]+"


def strip_spaces(c: ColumnLike) -> Column:
    return F.regexp_replace(as_col(c), r"\s", "")


def initials(c: ColumnLike) -> Column:
    """Upper-case initials, a fixed filler when missing."""
    return F.coalesce(F.upper(as_col(c)), F.lit(NO_INITIALS))


def code_word(first: ColumnLike, second: ColumnLike, date: ColumnLike) -> Column:
    """Build a code word; NULL when nothing was typed."""
    word = F.upper(paste([initials(first), initials(second), as_col(date)]))
    return F.nullif(word, F.lit(EMPTY_CODE))


def clean_key(
    key: ColumnLike,
    fallback: Column | None = None,
    drop_literal: str | None = None,
    prefix_fixes: Sequence[tuple[str, str]] = (),
) -> Column:
    """Repair typing errors in a subject key, then fall back to a code word.

    An address pasted alone leaves an empty text; that counts as missing, so
    the fallback applies.
    """
    out = as_col(key)
    if drop_literal:
        out = F.replace(out, F.lit(drop_literal), F.lit(""))
    for wrong, right in prefix_fixes:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    out = F.nullif(F.upper(F.trim(out)), F.lit(""))
    return out if fallback is None else F.coalesce(out, fallback)


def split_parts(c: ColumnLike, names: Sequence[str]) -> list[Column]:
    """Split on anything that is not a letter or digit; surplus parts are
    ignored and absent parts are NULL."""
    pieces = F.split(as_col(c), NON_ALNUM)
    return [F.try_element_at(pieces, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]


def pad_id(c: ColumnLike, prefix: str, width: int = 3) -> Column:
    """Zero-pad a bare number to a full id; anything else is left alone."""
    c = as_col(c)
    bare = c.rlike(rf"^\d{{1,{width}}}$")
    return F.when(bare, F.concat(F.lit(prefix), F.lpad(c, width, "0"))).otherwise(c)


def event_code(c: ColumnLike) -> Column:
    """Typed life-event answer to 0 none, 1 good, 2 neutral, 3 adverse.

    First rule wins. A missing or unreadable answer is neutral.
    """
    t = F.lower(as_col(c))
    plus, minus = t.contains("+"), t.contains("-")
    return (
        F.when(t.isin("", "0", "0x"), 0)
        .when(plus & minus, 2)
        .when(t.contains("*") | plus, 1)
        .when(t.contains("x"), 2)
        .when(minus, 3)
        .otherwise(2)
    )


def adverse(code: ColumnLike) -> Column:
    """1 for an adverse event, else 0; missing counts as none."""
    return F.when(as_col(code) == 3, 1).otherwise(0)
