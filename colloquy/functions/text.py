"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Words counted as fillers.
FILLERS = ("um", "umm", "uh", "uhh", "er", "erm", "ah", "hmm", "hm", "mm", "mmm", "mhm")


def _split(text: Column) -> Column:
    """Runs of lower-case letters, digits and apostrophes; everything else parts words."""
    return F.filter(F.split(F.regexp_replace(text, "[^a-z0-9']+", " "), " "), lambda w: w != "")


def normalize(text: Column, drop_fillers: bool = True) -> Column:
    """Words for scoring: lower case, pause tags out; letters, digits and apostrophes make words, all else parts them."""
    words = _split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\[pause[^\]]*\]", " "))
    return F.filter(words, lambda w: ~w.isin(*FILLERS)) if drop_fillers else words


def spoken(text: Column) -> Column:
    """Words as spoken, for verbatim scores: as normalize, but fillers stay and so do the words of pause tags."""
    return _split(F.lower(F.coalesce(text, F.lit(""))))


def clean(text: Column) -> Column:
    """Training text: lower case, everything but letters, digits, apostrophes, hyphens and blanks out, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9'\- ]", " "), " +", " "))


def verbatim(text: Column) -> Column:
    """Words with fillers kept."""
    return normalize(text, drop_fillers=False)


def strip_tags(text: Column) -> Column:
    """Special tokens in angle bars removed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|[^|]*\|>", ""))


def _distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences: common ends off, then one row of the table at a time as the
    bits of two integers, where a cell is one more, one less or the same as the cell beside it."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, score = every, 0, len(a)
    for w in b:
        same = places.get(w, 0)
        still = same | less
        carry = (((same & more) + more) ^ more) | same
        up = less | (every & ~(carry | more))
        down = more & carry
        score += bool(up & last) - bool(down & last)
        up = up << 1 | 1
        more = (down << 1 | ~(still | up)) & every
        less = up & still & every
    return score


@F.pandas_udf(LongType())
def edit_distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Word Levenshtein distance of two arrays, 64 cells of the table a step, linear in memory; a null array is empty."""
    for a, b in pairs:
        yield pd.Series([_distance([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def tenths(us: Column) -> Column:
    """Microseconds to tenths of a second, half up, in integers."""
    return F.floor((us + 50_000) / 100_000).cast("long")


def clock(us: Column) -> Column:
    """[mm:ss.s]"""
    t = tenths(us)
    minutes, rest = F.floor(t / 600).cast("long"), F.pmod(t, F.lit(600))
    return F.concat(F.lit("["), F.lpad(minutes.cast("string"), F.greatest(F.lit(2), F.length(minutes.cast("string"))), "0"), F.lit(":"), F.lpad(F.floor(rest / 10).cast("string"), 2, "0"), F.lit("."), (rest % 10).cast("string"), F.lit("]"))


def render(start_us: Column, speaker: Column, text: Column) -> Column:
    """[mm:ss.s] speaker: text"""
    return F.concat(clock(start_us), F.lit(" "), speaker, F.lit(": "), text)


def quantize(us: Column, tick_us: int = 20_000) -> Column:
    """Down to a grid, half up."""
    return (F.floor((us + tick_us // 2) / tick_us) * tick_us).cast("long")


def rendered_parts(text: Column) -> Column:
    """The text cut at its pause tags: an array of (pause: whether a tag, text: the seconds of a tag or the words between)."""
    tag = r"\[pause ([0-9.]+)s\]"
    between = F.split(text, tag)
    seconds = pause_tags(text)
    parts = F.flatten(F.transform(between, lambda t, i: F.array(F.struct(F.lit(False).alias("pause"), F.trim(t).alias("text")), F.struct(F.lit(True).alias("pause"), F.get(seconds, i).alias("text")))))
    return F.filter(parts, lambda x: F.coalesce(x["text"], F.lit("")) != "")


def pause_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[pause ([0-9.]+)s\]"), 1)


def filler_count(text: Column) -> Column:
    return F.size(F.filter(verbatim(text), lambda w: w.isin(*FILLERS)))


def color_index(speaker: Column, colors: int = 8) -> Column:
    """A stable color: trailing number mod colors, else the sum of code points."""
    number = F.regexp_extract(speaker, r"(\d{1,18})$", 1).try_cast("long")
    letters = F.aggregate(F.filter(F.split(speaker, ""), lambda c: c != ""), F.lit(0), lambda s, c: s + F.ascii(c))
    return F.pmod(F.coalesce(number, letters.cast("long")), F.lit(colors)).cast("int")


def display_label(raw: Column) -> Column:
    """SPEAKER_03 to Speaker_4; labels without a number stay."""
    n = F.regexp_extract(raw, r"(\d{1,9})$", 1).try_cast("long")
    return F.coalesce(F.concat(F.lit("Speaker_"), (n + 1).cast("string")), raw)


def token_cap(length_us: Column) -> Column:
    """Most tokens a recogniser may put out for a clip."""
    return F.least(F.lit(224), F.floor(8 * length_us / 1_000_000) + 24).cast("int")
