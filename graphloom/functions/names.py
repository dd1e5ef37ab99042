"""Jaro-Winkler similarity over UTF-8 bytes, vectorised over Arrow batches.

Spark has no such function. Two texts are compared byte by byte; the common-prefix boost (0.1 per byte,
four at most) applies only where the Jaro part is above 0.7, and an empty text scores 0.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_WEIGHT = 0.1
PREFIX_BYTES = 4
BOOST_ABOVE = 0.7
_CELLS_PER_PASS = 4_000_000


def byte_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, with the start and the length of each."""
    arr = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return flat, bounds[:-1], np.diff(bounds)


def byte_matrix(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One zero-padded row of bytes per text."""
    cols = np.arange(max(int(lengths.max(initial=0)), 1))
    where = np.minimum(starts[:, None] + cols, len(flat) - 1)
    return np.where(cols < lengths[:, None], flat[where], 0)


def _boosted(jaro: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """``jaro + prefix * weight * (1 - jaro)`` rounded once, so that a score on a threshold falls as in SQL."""
    return ((prefix * PREFIX_WEIGHT).astype(np.longdouble) * (1.0 - jaro) + jaro).astype(np.float64)


def jaro_winkler(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Similarity of row i of ``a`` to row i of ``b`` (byte matrices with their lengths)."""
    n, width_b = b.shape
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    taken = np.zeros(b.shape, bool)
    used = np.zeros(a.shape, bool)
    rows, cols = np.arange(n), np.arange(width_b)
    far = int(reach.max(initial=0))
    for i in range(a.shape[1]):
        lo, hi = max(0, i - far), min(width_b, i + far + 1)
        if lo >= hi:
            break
        span = cols[lo:hi]
        free = (b[:, lo:hi] == a[:, i, None]) & ~taken[:, lo:hi]
        free &= (np.abs(span - i) <= reach[:, None]) & (span < lb[:, None]) & (i < la)[:, None]
        at = free.argmax(1)
        hit = free[rows, at]
        used[hit, i] = True
        taken[rows[hit], at[hit] + lo] = True
    m = used.sum(1)
    k = min(a.shape[1], width_b)
    in_a = np.take_along_axis(a, np.argsort(~used, axis=1, kind="stable"), 1)[:, :k]
    in_b = np.take_along_axis(b, np.argsort(~taken, axis=1, kind="stable"), 1)[:, :k]
    swaps = ((in_a != in_b) & (np.arange(k) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - swaps) / m) / 3.0
    jaro = np.where(m > 0, jaro, 0.0)
    p = min(PREFIX_BYTES, k)
    same = (a[:, :p] == b[:, :p]) & (np.arange(p) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(1)
    return np.where(jaro > BOOST_ABOVE, _boosted(jaro, prefix), jaro)


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]
_WORD = 64
_PAIRS_PER_PASS = 32_768


def _long_pairs(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``jaro_winkler`` for texts too long for one machine word, in passes of bounded size."""
    (fa, sa, la), (fb, sb, lb) = a, b
    out = np.zeros(len(i))
    longest = np.maximum(la[i], lb[j])
    order = np.argsort(longest, kind="stable")
    at = 0
    while at < len(order):
        # widths grow along ``order``: halve the pass until its padded size fits
        size = len(order) - at
        while size > 1 and size * int(longest[order[at + size - 1]]) > _CELLS_PER_PASS:
            size = (size + 1) // 2
        pick = order[at : at + size]
        x, y = i[pick], j[pick]
        out[pick] = jaro_winkler(byte_matrix(fa, sa[x], la[x]), la[x], byte_matrix(fb, sb[y], lb[y]), lb[y])
        at += size
    return out


def _windows(reach: int, width: int) -> np.ndarray:
    """Bit masks of the positions within ``r`` of position ``k``, for every r and k."""
    full = (1 << _WORD) - 1
    return np.array(
        [[((1 << min(k + r + 1, _WORD)) - 1) & ~((1 << max(k - r, 0)) - 1) & full for k in range(width)] for r in range(reach + 1)],
        dtype=np.uint64,
    )


def pair_scores(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """Similarity of text ``i[k]`` of ``a`` to text ``j[k]`` of ``b``; values below ``floor`` may come out lower.

    The positions of every byte in a text of ``b`` are one machine word, so a step over the bytes of ``a``
    is a few word operations for all pairs at once.
    """
    (fa, sa, la), (fb, sb, lb) = a, b
    long = (la[i] > _WORD) | (lb[j] > _WORD)
    out = np.zeros(len(i))
    if long.any():
        out[long] = _long_pairs(a, b, i[long], j[long])
        if long.all():
            return out
    present = np.unique(fb)
    none = len(present)  # stands for "no such byte in b" and for the space after a text
    code = np.full(256, none, np.int64)
    code[present] = np.arange(none)

    def codes(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        short = np.minimum(lengths, _WORD)
        where = np.arange(max(int(short.max(initial=0)), PREFIX_BYTES)) < short[:, None]
        return np.ascontiguousarray(np.where(where, code[byte_matrix_to(flat, starts, short, where.shape[1])], none).T)

    ca, cb = codes(fa, sa, la), codes(fb, sb, lb)
    places = np.zeros((len(lb), none + 1), np.uint64)
    rows = np.arange(len(lb))
    for k in range(cb.shape[0]):
        places[rows, cb[k]] |= np.uint64(1 << k)
    places[:, none] = 0
    places = places.ravel()
    windows = _windows(_WORD // 2, ca.shape[0])
    pending = np.nonzero(~long)[0]
    pending = pending[np.argsort(la[i[pending]], kind="stable")]
    for at in range(0, len(pending), _PAIRS_PER_PASS):
        pick = pending[at : at + _PAIRS_PER_PASS]
        out[pick] = _word_scores(ca, la, cb, lb, places, none, windows, i[pick], j[pick], floor)
    return out


def byte_matrix_to(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    where = np.minimum(starts[:, None] + np.arange(width), len(flat) - 1)
    return flat[where]


def _word_scores(ca, la, cb, lb, places, none, windows, i, j, floor) -> np.ndarray:
    n1, n2 = la[i], lb[j]
    reach = np.maximum(np.maximum(n1, n2) // 2 - 1, 0)
    base = j * (none + 1)
    taken, used = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
    for k in range(int(n1.max(initial=0))):
        free = places[base + ca[k][i]] & windows[reach, k] & ~taken
        taken |= free & (~free + np.uint64(1))
        used |= (free != 0).astype(np.uint64) << np.uint64(k)
    m = np.bitwise_count(used).astype(np.int64)
    alike = [(ca[k][i] == cb[k][j]) & (k < n1) & (k < n2) for k in range(PREFIX_BYTES)]
    prefix = np.cumprod(alike, axis=0).sum(0)

    def score(pick: np.ndarray, swaps: np.ndarray | int) -> np.ndarray:
        x, y, z = m[pick], n1[pick], n2[pick]
        jaro = (x / y + x / z + (x - swaps) / x) / 3.0
        return np.where(jaro > BOOST_ABOVE, _boosted(jaro, prefix[pick]), jaro)

    out = np.zeros(len(i))
    some = np.nonzero(m > 0)[0]
    out[some] = score(some, 0)
    # order matters only where the best case reaches the floor
    some = some[out[some] >= floor]
    ua, ub, x, y = used[some], taken[some], i[some], j[some]
    unlike = np.zeros(len(some), np.int64)
    for _ in range(int(m[some].max(initial=0))):
        one = np.uint64(1)
        p, q = ((np.bitwise_count((w & (~w + one)) - one) & 63).astype(np.int64) for w in (ua, ub))
        unlike += (ca[p % ca.shape[0], x] != cb[q % cb.shape[0], y]) & (ua != 0)
        ua, ub = ua & (ua - one), ub & (ub - one)
    out[some] = score(some, unlike // 2)
    return out


_CLASSES, _DEPTH = 32, 4


def _byte_sets(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: two words with a bit per byte class and repeat up to ``_DEPTH``, the bytes beyond, and the first four bytes."""
    flat, starts, lengths = rows
    n = len(lengths)
    whose = np.repeat(np.arange(n), lengths)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(len(whose))
    counts = np.bincount(whose * _CLASSES + (flat[at] % _CLASSES if len(whose) else whose), minlength=n * _CLASSES).reshape(-1, _CLASSES)
    bits = np.uint64(1) << np.arange(_CLASSES, dtype=np.uint64)
    planes = [((counts > k) * bits).sum(1, dtype=np.uint64) for k in range(_DEPTH)]
    words = [planes[k] | planes[k + 1] << np.uint64(_CLASSES) for k in (0, 2)]
    head = np.ascontiguousarray(byte_matrix_to(flat, starts, np.minimum(lengths, PREFIX_BYTES), PREFIX_BYTES)).astype(np.uint8)
    head[np.arange(PREFIX_BYTES) >= lengths[:, None]] = 0
    return words[0], words[1], np.maximum(counts - _DEPTH, 0).sum(1), head.view(np.uint32).ravel()


def _can_reach(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray, floor: float) -> np.ndarray:
    """Numbers of the pairs whose shared bytes and first bytes allow a similarity of ``floor``; none that reaches it is missing."""
    (low_a, high_a, over_a, head_a), (low_b, high_b, over_b, head_b) = _byte_sets(a), _byte_sets(b)
    inv_a, inv_b = (1.0 / np.maximum(x[2], 1) for x in (a, b))
    need = np.array([3.0 * lowest_jaro(floor, k) - 1.0 for k in range(PREFIX_BYTES + 1)]) - 1e-4
    shared = np.bitwise_count(low_a[i] & low_b[j]) + np.bitwise_count(high_a[i] & high_b[j]) + np.minimum(over_a[i], over_b[j])
    bound = shared * (inv_a[i] + inv_b[j])
    pick = np.flatnonzero(bound >= need.min())
    unlike = head_a[i[pick]] ^ head_b[j[pick]]  # the first byte is the lowest one
    prefix = sum(((unlike & np.uint32((1 << 8 * k) - 1)) == 0).astype(np.int64) for k in range(1, PREFIX_BYTES)) + (unlike == 0)
    return pick[bound[pick] >= need[prefix]]


def column_scores(left: pa.Array, right: pa.Array, floor: float = 0.0) -> np.ndarray:
    """Similarity of each row's two texts (null: empty); values below ``floor`` may come out lower.

    Different texts are prepared once. Pairs that cannot reach the floor are left at 0, and of the others the different ones are scored.
    """
    sides = [pc.fill_null(x, "").dictionary_encode() for x in (left, right)]
    a, b = (byte_rows(x.dictionary) for x in sides)
    i, j = (x.indices.to_numpy().astype(np.int64) for x in sides)
    out = np.zeros(len(i))
    some = _can_reach(a, b, i, j, floor) if floor > 0 else np.arange(len(i))
    if len(some):
        pairs, again = np.unique(i[some] * len(b[2]) + j[some], return_inverse=True)
        out[some] = pair_scores(a, b, *np.divmod(pairs, len(b[2])), floor)[again]
    return out


@lru_cache
def _scored_once(floor: float):
    @F.arrow_udf(T.DoubleType())
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        nulls = pc.or_(left.is_null(), right.is_null()).to_numpy(zero_copy_only=False)
        return pa.array(column_scores(left, right, floor), mask=nulls)

    # Declared nondeterministic so that a filter on the score is not pushed below it with a second evaluation.
    return score.asNondeterministic()


def jaro_winkler_similarity(left: Column, right: Column, floor: float = 0.0) -> Column:
    """Similarity of two columns; where it is below ``floor`` it may come out lower."""
    return _scored_once(float(floor))(left, right)


def lowest_jaro(threshold: float, prefix: int) -> float:
    """The smallest Jaro value that can reach ``threshold`` with ``prefix`` equal leading bytes."""
    boosted = (threshold - PREFIX_WEIGHT * prefix) / (1.0 - PREFIX_WEIGHT * prefix)
    return min(threshold, max(BOOST_ABOVE, boosted))


def length_can_reach(left: Column, right: Column, threshold: float) -> Column:
    """False only where the byte lengths alone rule ``threshold`` out."""
    n1, n2 = F.octet_length(left), F.octet_length(right)
    # at most min(n1, n2) bytes match, so m/n1 + m/n2 <= 1 + min/max
    need = 3.0 * lowest_jaro(threshold, PREFIX_BYTES) - 2.0 - 1e-9
    return F.least(n1, n2).cast("double") >= F.greatest(n1, n2) * F.lit(need)
