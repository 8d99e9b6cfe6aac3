"""Text column expressions: trimming, scoring normalization, labels, ordered replacements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def words_of(col: Column) -> Column:
    """Split on white space, without empty words."""
    return F.filter(F.split(col, r"[ \t\n\r\x0b\x0c]+"), lambda x: x != "")


def normalize_words(col: Column) -> Column:
    """Words for scoring: lower case, hyphen as blank, only letters a-z and apostrophes."""
    clean = F.regexp_replace(F.replace(F.lower(col), F.lit("-"), F.lit(" ")), "[^a-z' ]", " ")
    return F.filter(F.split(clean, " +"), lambda x: x != "")


def prepare_label(col: Column) -> Column:
    """One leading blank; the first character in upper case if it is a letter."""
    text = strip(col)
    first = F.substring(text, 1, 1)
    rest = F.substr(text, F.lit(2))
    return F.concat(F.lit(" "), F.when(first.rlike(r"^\p{L}"), F.upper(first)).otherwise(first), rest)


def replace_in_order(col: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Apply (from, to) replacements one after the other.

    Neighbouring single-character entries become one character map, which a
    later entry also applies to the outputs of earlier ones. A long map is one
    ``translate`` pass, a short one a few plain replacements, which are cheaper.
    """
    chars: dict[str, str] = {}

    def flush(c):
        if len(chars) > 8:
            # translate() drops characters beyond the end of its second argument.
            kept = sorted(chars.items(), key=lambda e: e[1] == "")
            c = F.translate(c, "".join(a for a, _ in kept), "".join(b for _, b in kept))
        else:
            c = replace_each(c, pending)
        chars.clear()
        pending.clear()
        return c

    def replace_each(c, entries):
        for old, new in entries:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    pending: list[tuple[str, str]] = []
    for old, new in table:
        if len(old) == 1 and len(new) <= 1:
            for key, value in chars.items():
                if value == old:
                    chars[key] = new
            chars.setdefault(old, new)
            pending.append((old, new))
        else:
            col = replace_each(flush(col), [(old, new)])
    return flush(col)
