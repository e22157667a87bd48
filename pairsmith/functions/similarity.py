"""Similarity measures (M1-M22) as Column builders over token arrays, strings, numbers and vectors.

Set measures come in two flavours that differ on empty sets: ``joined`` (two empties: 1, one empty: 0) and ``feature``
(null as soon as a side is empty).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def from_counts(name: str, o: Column, x: Column, y: Column) -> Column:
    """A set measure from overlap and sizes (or their weighted counterparts)."""
    o, x, y = o.cast("double"), x.cast("double"), y.cast("double")
    return {
        "jac": lambda: F.try_divide(o, x + y - o),
        "cos": lambda: F.try_divide(o, F.sqrt(x * y)),
        "dice": lambda: F.try_divide(2 * o, x + y),
        "coeff": lambda: F.try_divide(o, F.least(x, y)),
        "overlap": lambda: o,
    }[name]()


def joined(name: str, a: Column, b: Column) -> Column:
    x, y = F.size(a), F.size(b)
    if name == "overlap":
        return overlap(a, b).cast("double")
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(from_counts(name, overlap(a, b), x, y))


def feature(name: str, a: Column, b: Column) -> Column:
    x, y = F.size(a), F.size(b)
    return F.when((x > 0) & (y > 0), from_counts(name, overlap(a, b), x, y))


def weighted(name: str, o: Column, x: Column, y: Column) -> Column:
    """M6-M10 from the idf sums of the overlap and of both records; two weightless records count as equal."""
    if name == "overlap":
        return o
    return F.when((x <= EPS) & (y <= EPS), 1.0).when((x <= EPS) | (y <= EPS), 0.0).otherwise(from_counts(name, o, x, y))


def _present(a: Column, b: Column, value: Column) -> Column:
    return F.when((a != "") & (b != ""), value)


def levenshtein(a: Column, b: Column) -> Column:
    """M11, joins: the distance to an empty string is the other's length."""
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def levenshtein_feature(a: Column, b: Column) -> Column:
    return _present(a, b, F.levenshtein(a, b).cast("double"))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """M12; null for two empty strings."""
    return 1 - F.try_divide(levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double"))


def exact(a: Column, b: Column) -> Column:
    """M13 as a feature."""
    return _present(a, b, (a == b).cast("double"))


def absolute_norm(a: Column, b: Column) -> Column:
    """M14 as a feature: null if a side is no number."""
    x, y = a.try_cast("double"), b.try_cast("double")
    most = F.greatest(F.abs(x), F.abs(y))
    return F.when(x.isNull() | y.isNull(), None).when((F.abs(x) < EPS) | (F.abs(y) < EPS), 0.0).when(F.abs(x - y) / most <= EPS, 1.0).otherwise(1 - F.abs(x - y) / most)


def vector_cosine(a: Column, b: Column) -> Column:
    """M18; null if a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def coherent_factor(a: Column, b: Column) -> Column:
    """Cosines of all pairs of the union of two lists of word vectors, summed and divided by the union's size."""
    u = F.array_sort(F.array_union(a, b))
    pairs = F.flatten(F.transform(u, lambda x, i: F.transform(F.slice(u, i + 2, F.size(u)), lambda y: vector_cosine(x, y))))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0))) / F.size(u)


def binary_entropy(p: Column) -> Column:
    """M20."""
    part = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    return -(part(p) + part(1 - p))


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    near = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - near), min(len(b), i + near + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(first, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _jaro_winkler(a: str, b: str) -> float:
    j = _jaro(a, b)
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return j + 0.1 * same * (1 - j) if j > 0.7 else j


def _monge_elkan(a: str, b: str) -> float:
    left, right = a.split(), b.split()
    return sum(max((_jaro_winkler(x, y) for y in right), default=0.0) for x in left) / len(left) if left else 0.0


def _align(a: str, b: str, local: bool, gap: float) -> float:
    row = [0.0 if local else -gap * j for j in range(len(b) + 1)]
    best = 0.0
    for i, x in enumerate(a, 1):
        new = [0.0 if local else -gap * i]
        for j, y in enumerate(b, 1):
            s = max(row[j - 1] + (x == y), row[j] - gap, new[-1] - gap)
            new.append(max(0.0, s) if local else s)
        row = new
        best = max(best, max(row))
    return best if local else row[-1]


def _affine(a: str, b: str, start: float = 1.0, more: float = 0.5) -> float:
    low = -math.inf
    m, x, y = [0.0] + [low] * len(b), [low] * (len(b) + 1), [low] + [-start - more * j for j in range(len(b))]
    for i, c in enumerate(a, 1):
        nm, nx, ny = [low], [-start - more * (i - 1)], [low]
        for j, d in enumerate(b, 1):
            nm.append((c == d) + max(m[j - 1], x[j - 1], y[j - 1]))
            nx.append(max(m[j] - start, x[j] - more))
            ny.append(max(nm[j - 1] - start, ny[j - 1] - more))
        m, x, y = nm, nx, ny
    return max(m[-1], x[-1], y[-1])


#: Measures without a built-in counterpart, as vectorised functions.
SLOW: dict[str, Callable[[str, str], float]] = {
    "jaro": _jaro,
    "jaro_winkler": _jaro_winkler,
    "monge_elkan": _monge_elkan,
    "smith_waterman": lambda a, b: _align(a, b, True, 1.0),
    "needleman_wunsch": lambda a, b: _align(a, b, False, 1.0),
    "affine": _affine,
}


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; those beyond the shorter string do."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: ~x.eqNullSafe(y)), lambda d: d)).cast("double")


def slow(name: str) -> Callable[[Column, Column], Column]:
    one = SLOW[name]

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b, strict=True))
        found = {p: None if p[0] is None or p[1] is None else one(*p) for p in set(pairs)}  # values repeat
        return pd.Series([found[p] for p in pairs], dtype="float64")

    return F.pandas_udf(run, "double")


def relative_difference(a: Column, b: Column) -> Column:
    """2|a - b| / (|a| + |b|)."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when((x == 0) & (y == 0), 0.0).otherwise(F.try_divide(2 * F.abs(x - y), F.abs(x) + F.abs(y)))


REGISTRY: dict[str, Callable[[Column, Column], Column]] = {}


def register_similarity(name: str, builder: Callable[[Column, Column], Column]) -> None:
    """A measure of two string columns that features may name."""
    REGISTRY[name] = builder


for _name, _f in {"lev": levenshtein_feature, "exm": exact, "anm": absolute_norm, "lev_sim": levenshtein_similarity, "rel_diff": relative_difference, "hamming": hamming}.items():
    register_similarity(_name, _f)
for _name in SLOW:
    register_similarity(_name, lambda a, b, name=_name: slow(name)(a, b))
