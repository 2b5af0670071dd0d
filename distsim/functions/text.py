"""Column functions for cleaning, splitting and windowing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters removed from a line before tokenizing. Square
# brackets, digits and non-ASCII letters stay.
SPECIAL_CHARACTERS = "~!@#$^%&*\\()_+={}|;:\"'<,>.?`/-"
_SPECIAL_RUN = "[" + "".join("\\" + c for c in SPECIAL_CHARACTERS) + "]+"

# Fixed value: every character that a bare Python ``str.split()`` treats as white space.
WHITE_SPACE = (
    r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_line(line: Column | str) -> Column:
    """Delete the special characters, then collapse runs of spaces to one space.

    Both patterns match only what changes: ``translate`` looks every character up, and a single
    space need not be replaced by itself.
    """
    return F.regexp_replace(F.regexp_replace(as_column(line), _SPECIAL_RUN, ""), " {2,}", " ")


def split_fields(line: Column | str, separator: str = " ") -> Column:
    """Split on one character and drop trailing empty fields.

    An empty line gives one empty field; a line of separators only gives none.
    """
    line = as_column(line)
    body = F.rtrim(line, F.lit(separator))
    return (
        F.when(line == "", F.array(F.lit("")))
        .when(body == "", F.array().cast("array<string>"))
        .otherwise(F.split(body, separator))
    )


def tokenize(line: Column | str, clean: bool = False) -> Column:
    """Tokens of a line, split on single spaces (see :func:`split_fields`)."""
    return split_fields(clean_line(line) if clean else line, " ")


def token_windows(tokens: Column | str, n: int) -> Column:
    """All windows of ``n`` tokens as an array of structs with fields ``w1`` .. ``wn``.

    A list shorter than ``n`` gives one window whose missing tokens are null. Zipping
    shifted slices keeps the whole expression inside generated code, which a
    ``transform`` with a lambda would not.
    """
    if n < 1:
        raise ValueError(f"window size must be at least 1, got {n}")
    tokens = as_column(tokens)
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(1))
    return F.arrays_zip(*[F.slice(tokens, i + 1, count).alias(f"w{i + 1}") for i in range(n)])
