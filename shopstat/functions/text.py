"""Text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that marks a missing value in the shop's exports.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
PLACEHOLDER_TOKENS = ["", "None", "0", "?"]


def norm_label(c: Column) -> Column:
    """Group label as compared by the tests: trimmed and upper case."""
    return F.upper(F.trim(c))


def null_tokens(c: Column, tokens=NA_TOKENS) -> Column:
    """Text equal (after trimming) to a missing-value token becomes null."""
    return F.when(F.trim(c).isin(tokens), F.lit(None).cast("string")).otherwise(c)


def first_fields(line: Column, n: int = 10, sep: str = ",") -> Column:
    """Cut a line at every separator and keep the first ``n`` pieces."""
    return F.slice(F.split(line, sep), 1, n)


def field(arr: Column, i: int) -> Column:
    """Element ``i`` (0-based) or null when the array is shorter."""
    return F.get(arr, i)


def strip_line_breaks(c: Column) -> Column:
    return F.translate(c, "\r\n", "  ")


def drop_replacement_chars(c: Column) -> Column:
    """Undecodable bytes are read as U+FFFD; dropping them mimics decoding
    with errors ignored."""
    return F.regexp_replace(c, "�", "")


def concat_key(*cols: Column, sep: str = "-", null_text: str = "nan") -> Column:
    """Join values with ``sep``; a missing value prints as ``null_text`` so
    the key is never null."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit(null_text)) for c in cols])


def sql_len(c: Column) -> Column:
    """Length ignoring trailing blanks."""
    return F.length(F.rtrim(c.cast("string")))


_QUOTED = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+\""""


def pyliteral_to_json(c: Column) -> Column:
    """Make a Python literal list/dict text readable by ``from_json``.

    Single quotes are accepted by the JSON reader as is.  The bare words
    ``None``, ``True`` and ``False`` become ``null``, ``true``, ``false``;
    quoted strings are stepped over whole (escapes included), so free text is
    left as it is.  From the end of one match (``\\G``) the pattern consumes
    quoted strings and other characters up to the next bare word, without
    going back.  Cells without any of the words skip this.
    """
    fixed = c
    for word, repl in (("None", "null"), ("True", "true"), ("False", "false")):
        first, rest = word[0], word[1:]
        fixed = F.regexp_replace(fixed, rf"""(?s)\G((?:[^'"{first}]++|{_QUOTED}|{first}(?!{rest}\b))*+){word}\b""", f"$1{repl}")
    return F.when(c.contains("None") | c.contains("True") | c.contains("False"), fixed).otherwise(c)
