"""Scalar expressions for cleaning, recoding and formatting. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indonesian month names, January to December.
MONTHS_ID = [
    "Januari", "Februari", "Maret", "April", "Mei", "Juni",
    "Juli", "Agustus", "September", "Oktober", "November", "Desember",
]

# Coded sex -> written-out sex, and the two label domains.
SEX_NAMES = {"L": "Laki-Laki", "P": "Perempuan"}
SEX_CODES = {"Laki-Laki": 1, "Perempuan": 0}
STATUS_CODES = {"Normal": 0, "Stunted": 1, "Severely Stunted": 2}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove whitespace of any kind at both ends (``trim`` alone only removes spaces)."""
    return F.btrim(_col(c), F.lit(" \t\n\x0b\f\r"))


def title_case(c: Column | str) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the other letters.

    Text of letters and spaces alone is what ``initcap`` handles. Other text is cut in front of
    each word, so the work is per word, not per character.
    """
    text = _col(c)
    words = F.split(text, r"(?<=\P{L})(?=\p{L})")
    cased = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    )
    return F.when(text.rlike(r"[^\p{L} ]"), F.array_join(cased, "")).otherwise(F.initcap(text))


def escape_breaks(c: Column | str) -> Column:
    """Line breaks as backslash escapes, backslashes doubled."""
    text = F.replace(_col(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape_breaks(c: Column | str) -> Column:
    """Inverse of :func:`escape_breaks`; a backslash before any other letter stays."""
    # Cut at doubled backslashes first, so that what is left of an escape is never one of them.
    parts = F.split(_col(c), r"\\\\")
    plain = F.transform(
        parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    )
    return F.array_join(plain, "\\")


def slug(c: Column | str) -> Column:
    """Lower-case name without parentheses, spaces as underscores."""
    return F.replace(F.regexp_replace(F.lower(_col(c)), r"[()]", ""), F.lit(" "), F.lit("_"))


def _map_literal(mapping: Mapping[Any, Any]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def recode(c: Column | str, mapping: Mapping[Any, Any]) -> Column:
    """Closed-domain lookup; a value outside the domain becomes NULL."""
    return _map_literal(mapping)[_col(c)]


def encode_label(c: Column | str, mapping: Mapping[str, int]) -> Column:
    return recode(c, mapping)


def decode_label(c: Column | str, mapping: Mapping[str, int]) -> Column:
    """Inverse of :func:`encode_label`."""
    return recode(c, {v: k for k, v in mapping.items()})


def lookup_default(c: Column | str, mapping: Mapping[Any, Any], default: Any) -> Column:
    return F.coalesce(recode(c, mapping), F.lit(default))


def to_numeric(c: Column | str) -> Column:
    """Text to double; unreadable text becomes NULL instead of an error."""
    return _col(c).try_cast("double")


def nan_to_null(c: Column | str) -> Column:
    return F.when(F.isnan(_col(c)), None).otherwise(_col(c))


def clip(c: Column | str, lower: float | Column, upper: float | Column) -> Column:
    """Limit to [lower, upper]; NULL and NaN stay (``greatest`` alone would skip or keep them as largest)."""
    c = _col(c)
    lo = lower if isinstance(lower, Column) else F.lit(lower)
    hi = upper if isinstance(upper, Column) else F.lit(upper)
    limited = F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))
    return F.when(F.isnan(c), F.lit(float("nan"))).otherwise(limited)


def outside(c: Column | str, lower: float, upper: float) -> Column:
    """Below or above the bounds; NaN, which Spark sorts above every number, is neither."""
    return ((_col(c) < F.lit(lower)) | (_col(c) > F.lit(upper))) & ~F.isnan(_col(c))


def round_half_even(c: Column | str, digits: int) -> Column:
    return F.bround(_col(c), digits)


def fmt_fixed(c: Column | str, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", _col(c))


def fmt_signed(c: Column | str, digits: int = 4) -> Column:
    return F.format_string(f"%+.{digits}f", _col(c))


def fmt_percent(share: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", _col(share) * 100)


def fmt_scientific(c: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}e", _col(c))


def fmt_left(c: Column | str, width: int) -> Column:
    return F.format_string(f"%-{width}s", _col(c))


def param_label(depth: Column | str, split: Column | str, leaf: Column | str) -> Column:
    """``depth=.., split=.., leaf=..`` with an unlimited depth shown as ``None``."""
    shown = F.coalesce(_col(depth).cast("string"), F.lit("None"))
    return F.format_string(
        "depth=%s, split=%s, leaf=%s", shown, _col(split).cast("string"), _col(leaf).cast("string")
    )


def recall_verdict(recall: Column | str) -> Column:
    """Baseline wording: a class never found is a total failure."""
    return F.when(_col(recall) == 0, "GAGAL total!").otherwise("Terbatas")


def recall_grade(recall: Column | str) -> Column:
    """Best-model wording: more than half found is good."""
    return F.when(_col(recall) > 0.5, "Baik").otherwise("Perlu ditingkatkan")


def sign_mark(delta: Column | str) -> Column:
    return F.when(_col(delta) > 0, "+").otherwise("-")


def localized_date(c: Column | str) -> Column:
    """``day month-name year`` without leading zeros."""
    names = F.array(*[F.lit(m) for m in MONTHS_ID])
    return F.concat_ws(
        " ",
        F.dayofmonth(_col(c)).cast("string"),
        F.element_at(names, F.month(_col(c))),
        F.year(_col(c)).cast("string"),
    )


def logspace(low: float, high: float, n: int) -> list[float]:
    """n points from 10**low to 10**high, evenly spaced in the exponent."""
    if n == 1:
        return [10.0**low]
    return [10.0 ** (low + (high - low) * i / (n - 1)) for i in range(n)]


def argmax_first(scores: Sequence[Column], values: Sequence[Any]) -> Column:
    """Value belonging to the highest score; the first one listed wins a tie."""
    if len(scores) == 1:
        return F.lit(values[0])
    top = F.greatest(*scores)
    pairs = list(zip(scores, values))
    start = F.when(pairs[0][0] == top, F.lit(pairs[0][1]))
    return reduce(lambda acc, p: acc.when(p[0] == top, F.lit(p[1])), pairs[1:], start)
