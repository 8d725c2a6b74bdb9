"""Column functions that several operators share: rounding rules, grids and number texts."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def ppm(x: Column) -> Column:
    """A ratio as whole parts per million."""
    return round_half_up(x * F.lit(1e6))


def floor_to(x: Column, grid: int) -> Column:
    """The grid line at or below whole ``x``, also for negative numbers."""
    return (x - F.pmod(x, F.lit(grid))).cast("long")


def ceil_to(x: Column, grid: int) -> Column:
    return (x + F.pmod(-x, F.lit(grid))).cast("long")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def fixed_text(x: Column, places: int, suffix: str = "") -> Column:
    """A decimal with ``places`` digits, halves away from zero."""
    return F.concat(F.round(x, places).cast(f"decimal(38,{places})").cast("string"), F.lit(suffix))


def even_text(x: Column, places: int, trim: bool = False) -> Column:
    """A decimal with ``places`` digits, halves to even; trailing zeros go if ``trim``."""
    text = F.bround(x, places).cast(f"decimal(38,{places})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if trim else text


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equally long arrays in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, first occurrences in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def ease_in_cubic(t: Column) -> Column:
    return t * t * t


def ease_out_cubic(t: Column) -> Column:
    return 1 - (1 - t) * (1 - t) * (1 - t)


def ease_in_out_cubic(t: Column) -> Column:
    back = 2 - 2 * t
    return F.when(t < 0.5, 4 * t * t * t).otherwise(1 - back * back * back / 2)


def semver_key(version: Column) -> Column:
    """major.minor.patch as a struct that orders as versions do; null if it is none."""
    part = lambda i: F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)$", i).cast("int")
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


#: White space: what ends a word in any script.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalised(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form NFKC or NFC; texts of ASCII alone stay in the JVM, as they are their own form."""
    odd = F.when(F.octet_length(text) > F.char_length(text), text)
    return F.coalesce({"NFKC": _nfkc, "NFC": _nfc}[form](odd), text)


#: The characters of ``BLANKS`` but the blank itself, one by one.
_OTHER_BLANKS = "".join(c for c in map(chr, range(1 << 16)) if re.match(f"[{BLANKS}]", c) and c != " ")


def collapsed(text: Column) -> Column:
    """Without white space at the ends, and one blank for each run of it inside."""
    # translated first: a regular expression that tries so large a class at each character takes several times as long
    return F.trim(F.regexp_replace(F.translate(text, _OTHER_BLANKS, " " * len(_OTHER_BLANKS)), " {2,}", " "))


def blank_tokens(text: Column) -> Column:
    """What white space parts, in order."""
    return F.filter(F.split(collapsed(text), " "), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores, in order."""
    return F.filter(F.split(F.lower(text), "[^A-Za-z0-9_]+"), lambda t: t != "")


def contains_all(text: Column, tokens_: Column) -> Column:
    """Whether every token is somewhere in the text; true for no tokens."""
    return F.forall(tokens_, lambda t: F.contains(text, t))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers of at most 63 bits, by Euclid's steps, of which 92 always do."""
    pair = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step, lambda s: s["a"])


def fraction_text(n: Column, d: Column) -> Column:
    """n/d in lowest terms, the sign in front, whole numbers without a denominator; null for a zero denominator."""
    g, sign = gcd(n, d), F.when(d < 0, -1).otherwise(1)
    top, low = (n * sign / g).cast("long").cast("string"), (F.abs(d) / g).cast("long")
    return F.when(d != 0, F.when(low == 1, top).otherwise(F.concat_ws("/", top, low.cast("string"))))


def is_date(text: Column) -> Column:
    """Whether a text is a day of the calendar as yyyy-MM-dd."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(day, "yyyy-MM-dd") == text), F.lit(False))


def date_text(day: Column, form: str) -> Column:
    """A date as ``iso-date``, ``year-month`` or ``year``."""
    return F.date_format(day, {"iso-date": "yyyy-MM-dd", "year-month": "yyyy-MM", "year": "yyyy"}[form])


def dbfs_milli(amplitude: Column, floor: int = -120000) -> Column:
    """A level in thousandths of a decibel below full scale, ``floor`` at least; silence is the floor."""
    level = round_half_up(F.log10(F.when(amplitude > 0, amplitude)) * 20000)
    return F.greatest(F.coalesce(level, F.lit(floor).cast("long")), F.lit(floor)).cast("long")


def mapped(ratio: Column, low: Column, high: Column) -> Column:
    """A ratio carried to the range from ``low`` to ``high``."""
    return low + (high - low) * ratio


def staggered(index: Column, each: Column, offset: Column) -> Column:
    return offset + index * each


def max_at(scores: Column, places: Column) -> Column:
    """The largest score at the given places, 0 at least; places beyond the end don't count."""
    return F.greatest(F.coalesce(F.array_max(F.transform(places, lambda i: F.get(scores, i))), F.lit(0.0)), F.lit(0.0))


def natural_earth(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Plane coordinates of degrees in the Natural Earth projection."""
    # fixed values: the projection's published polynomials
    x = (0.870700, -0.131979, -0.013791, 0.0, 0.0, 0.003971, -0.001529)  # of even powers 0 to 12
    y = (1.007226, 0.015085, 0.0, -0.044475, 0.028874, -0.005916)  # of even powers 0 to 10
    phi, lam = F.radians(lat), F.radians(lon)
    p2 = phi * phi
    horner = lambda c: reduce(lambda s, k: s * p2 + F.lit(k), reversed(c[:-1]), F.lit(c[-1]))
    return lam * horner(x), phi * horner(y)


def eased(t: Column, curve: Column) -> Column:
    """Progress 0 to 1 along the named curve; linear where the name is none of them."""
    return F.when(curve == "in-cubic", ease_in_cubic(t)).when(curve == "out-cubic", ease_out_cubic(t)).when(curve == "in-out-cubic", ease_in_out_cubic(t)).otherwise(t)
