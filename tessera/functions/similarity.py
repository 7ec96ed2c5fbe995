"""String similarity, 0 to 100 unless a name says otherwise; one Arrow pass gives all metrics of a pair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text pairs that a task remembers between batches.
SEEN = 1 << 16
METRICS = ("ratio", "partial", "token_sort", "token_set", "wratio", "jaro_winkler")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of *a* at a time."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string to a window of the longer, windows cut short at the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, m = len(a), len(b)
    chars = set(a)
    best = 0.0
    for start in range(1 - n, m):
        lo, hi = max(0, start), min(m, start + n)
        # a best window ends, or begins where it is cut short, with a letter of the shorter string
        if b[hi - 1] in chars or b[lo] in chars:
            best = max(best, ratio(a, b[lo:hi]))
            if best == 100.0:
                break
    return best


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def _set_parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_sort(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set(a: str, b: str) -> float:
    """Best ratio among the common words, and those with each side's own words; 0 if a side has no words."""
    if not a.split() or not b.split():
        return 0.0
    common, one, two = _set_parts(a, b)
    if common and (not one or not two):
        return 100.0
    left, right = f"{common} {one}".strip(), f"{common} {two}".strip()
    best = ratio(left, right)
    if common:
        best = max(best, ratio(common, left), ratio(common, right))
    return best


def wratio(a: str, b: str) -> float:
    """Blend by length: whole ratios where lengths are alike, discounted partial ones where they are not."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    common, one, two = _set_parts(a, b)
    words = 100.0 if common else max(partial(_sorted(a), _sorted(b)), partial(one, two))
    return max(best, scale * partial(a, b), 0.95 * scale * words)


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity, 0 to 1, raised by a common prefix of up to four letters where it is over 0.7."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    first = []
    for k, ch in enumerate(a):
        for j in range(max(0, k - reach), min(len(b), k + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


_SCORERS = {"ratio": ratio, "partial": partial, "token_sort": token_sort, "token_set": token_set, "wratio": wratio, "jaro_winkler": jaro_winkler}


def all_metrics(a: Column, b: Column, names: tuple[str, ...] = METRICS) -> Column:
    """Struct of the metrics *names* of two string columns, nulls as empty; equal pairs of a task are scored once, as far as its memory of them goes."""
    scorers = [_SCORERS[n] for n in names]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], list[float]] = {}
        for x, y in batches:
            if len(seen) > SEEN:
                seen.clear()
            rows = []
            for pair in zip(x.fillna(""), y.fillna("")):
                if pair not in seen:
                    seen[pair] = [float(f(*pair)) for f in scorers]
                rows.append(seen[pair])
            yield pd.DataFrame(rows, columns=list(names))

    return run(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.lit(1.0) - F.coalesce(F.try_divide(F.levenshtein(x, y).cast("double"), F.greatest(F.length(x), F.length(y))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def unit(v: Column) -> Column:
    """Vector of length one, or zeros."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))
