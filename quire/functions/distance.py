"""String distances as built-in column expressions (no UDF).

E5 levenshtein counts code points.  E6 hamming counts position mismatches, and
characters past the shorter string count as mismatches.  E7 jaccard is over
character *multisets*: sum of the smaller counts over sum of the larger counts,
1.0 when both are empty, 0.0 when exactly one is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.terms import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chars(c) -> Column:
    """Characters of a string; the empty string gives an empty array."""
    s = _col(c)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def levenshtein(a, b) -> Column:
    """E5."""
    return F.levenshtein(_col(a), _col(b))


def hamming(a, b) -> Column:
    """``zip_with`` pads the shorter side with NULL, which counts as a mismatch."""
    diffs = F.zip_with(chars(a), chars(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(diffs, F.lit(0), lambda acc, d: acc + d)


def _count_char(s: Column, ch: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, ch, F.lit("")))


def jaccard(a, b) -> Column:
    """Multiset character similarity."""
    sa, sb = _col(a), _col(b)
    # a character of both counts by its smaller count, and the union is what is left of the lengths
    inter = F.aggregate(F.array_distinct(chars(sa)), F.lit(0), lambda acc, ch: acc + F.least(_count_char(sa, ch), _count_char(sb, ch)))
    union = F.length(sa) + F.length(sb) - inter
    return F.when(union == 0, F.lit(1.0)).otherwise(inter.cast("double") / union.cast("double"))


def best_distance(candidates, reference, dist=levenshtein) -> Column:
    """A5: smallest distance of k candidates to the reference (NULL for no candidate)."""
    return F.array_min(distances(candidates, reference, dist))


def distances(candidates, reference, dist=levenshtein) -> Column:
    """Distance of every candidate, in candidate order (the list form of E10)."""
    return let(_col(reference), lambda ref: F.transform(_col(candidates), lambda p: dist(p, ref)))
