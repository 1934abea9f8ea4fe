"""Periodic runs of words, found with multi-scale minimizers.

A run is a longest stretch of consecutive words with smallest period q (words q apart are the same) whose
length is at least ``max(least, 2 q)``.

Periods under ``direct`` are found by direct lag scans: words are compared with those q further on.  Longer
periods are found scale by scale, the scale W covering W to 2 W - 1.  There the minimizers are the
smallest hashes of W/4 consecutive words in every window of W/4 + 1 such places.  A window spans W/2 words, so
inside a run the same window comes again q further on, within the run, and with it the same minimizer at
distance q.  Pairs of equal minimizers W to 2 W - 1 apart therefore are the seeds; a seed's lag is extended to both sides
word by word, and stays if the stretch is long enough.

Equal minimizers less than W/8 apart lie inside a stretch of a period that a smaller scale covers, where they may
stand at every word.  Such a cluster counts by its first and its last place only, so a place meets a
bounded number of others; as a run that begins or ends within the cluster may shift these by the cluster's own step, its
lags are also tried one and two steps up and down.  Work so stays nearly linear however repetitive a text is.  A stretch found
with several periods keeps the smallest; the others are its multiples.

Texts are read whole, a lot of them at a time, side by side in one array of word numbers with a number of its own between
each two, which no run can cross.  The work is row-local: no shuffle; memory is that of one lot, or of the
longest text.

Defined results: null, empty and blank texts have no words and no runs; ties for the longest run go to the smaller
start, then period; repeated rows each get the same result; an empty table gives an empty table; kept columns travel in a
struct, so names can't clash; very long texts form a lot of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import attach
from quarry.llm.decontaminate import with_text

DIRECT = 32
LEAST = 12
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring grams from theirs."""
    out = (h * MIX[0]) ^ (other * MIX[1] + (other >> np.uint64(29)))
    return out ^ (out >> np.uint64(32))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (width - size)], v[width - size:]) if width > size else v


def _direct(t: np.ndarray, direct: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches with a period under ``direct``, smallest or not."""
    out = []
    for q in range(1, min(direct, len(t) // 2 + 1)):
        same = np.flatnonzero(t[:-q] == t[q:])
        if not len(same):
            continue
        first = np.flatnonzero(np.diff(same, prepend=-2) != 1)
        n = np.diff(first, append=len(same))
        for k in np.flatnonzero(n >= max(least - q, q)).tolist():
            a = int(same[first[k]])
            out.append((a, a + int(n[k]) + q, q))
    return out


def _extent(t: np.ndarray, m: int, q: int) -> tuple[int, int]:
    """The longest stretch around ``m`` whose words equal those ``q`` further on; empty if word m doesn't."""
    def reach(a: np.ndarray, b: np.ndarray) -> int:
        at, size, n = 0, 64, min(len(a), len(b))
        while at < n:
            end = min(n, at + size)
            diff = a[at:end] != b[at:end]
            k = int(diff.argmax())
            if diff[k]:
                return at + k
            at, size = end, 2 * size
        return n
    right = reach(t[m:], t[m + q:])
    left = reach(t[:m][::-1], t[q:m + q][::-1])
    return m - left, m + right


def _seeds(grams: np.ndarray, k: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and lags of pairs of equal minimizers at distances that the scale covers, and (last place, first place,
    step) of clusters that follow each other closely."""
    n = len(grams)
    if n <= k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    least = _sliding_min((grams & ~low) | np.arange(n, dtype=np.uint64), k + 1) & low
    place = least[np.append(True, least[1:] != least[:-1])].astype(np.int64)
    order = np.lexsort((place, grams[place]))
    place = place[order]
    value = grams[place]
    near = np.append(False, (value[1:] == value[:-1]) & (place[1:] - place[:-1] < max(scale // 8, 1)))
    end = np.append(~near[1:], True)  # last of its cluster
    step = np.where(near, np.append(0, place[1:] - place[:-1]), 0)
    step[:-1] = np.where(near[1:], place[1:] - place[:-1], step[:-1])
    kept = ~near | end
    place, value, step = place[kept], value[kept], step[kept]
    close = np.flatnonzero((value[1:] == value[:-1]) & ~near[kept][1:] & (step[1:] > 0) & (step[1:] == step[:-1]) & (np.diff(place) < scale))
    follow = np.stack([place[close], place[close + 1], step[close]], axis=1)
    places, lags = [], []
    r = 1
    while r < len(place):
        gap = place[r:] - place[:-r]
        i = np.flatnonzero((value[r:] == value[:-r]) & (gap < 2 * scale + scale // 4))
        if not len(i):
            break
        steps = np.maximum(step[i], step[i + r])
        for by in (0, -2, -1, 1, 2):
            j = i if not by else i[steps > 0]
            lag = gap[j] + by * steps[steps > 0] if by else gap[j]
            ok = (lag >= scale) & (lag < 2 * scale)
            places.append(place[j[ok]])
            lags.append(lag[ok])
        r += 1
    place, lag = np.concatenate([[], *places]).astype(np.int64), np.concatenate([[], *lags]).astype(np.int64)
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    new = (np.diff(place, prepend=-1) != 0) | (np.diff(lag, prepend=-1) != 0)
    return place[new], lag[new], follow


def _across(t: np.ndarray, last: int, first: int, step: int, scale: int) -> Iterator[tuple[int, int]]:
    """Places and lags of runs whose one period lies in the stretch of period ``step`` around the cluster that ends at
    ``last``, and the other in that of the next cluster.  Such a lag's stretch follows from the borders of the two,
    unless both begin or both end a lag apart."""
    s1, e1 = _extent(t, last, step)
    s2, e2 = _extent(t, first, step)
    e1, e2 = e1 + step, e2 + step
    gap = first - last
    lag = np.arange(gap + -(-(scale - gap) // step) * step, 2 * scale, step)
    a, b = np.maximum(s1, s2 - lag), np.minimum(e1, e2 - lag)
    for i in np.flatnonzero((b > a) & ((b - a >= lag) | (s2 - lag == s1) | (e2 - lag == e1))).tolist():
        yield int(a[i] + b[i]) // 2, int(lag[i])


def _plausible(grams: np.ndarray, k: int, centre: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Whether 2 k words on either side of the centre come again at the lag: the stretch of a run has 4 k words or more."""
    def again(shift: int) -> np.ndarray:
        at = centre + shift
        inside = (at >= 0) & (at + lag < len(grams))
        out = np.zeros(len(centre), bool)
        out[inside] = grams[at[inside]] == grams[(at + lag)[inside]]
        return out
    return again(0) & again(k) | again(-k) & again(-2 * k)


def _by_scales(t: np.ndarray, ends: np.ndarray, direct: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches with a period of ``direct`` or more, smallest or not."""
    sizes = np.diff(ends, prepend=0)
    out: list[tuple[int, int, int]] = []
    scale, k = direct, max(1, direct // 4)
    where = None  # places of the array in the whole one
    grams, size = None, 1
    while (long := sizes > 2 * scale).any():
        if where is None or not long.all():  # only texts of two periods or more stay
            stay = np.repeat(long, sizes)
            where = np.flatnonzero(stay) if where is None else where[stay]
            t = t[stay]
            sizes = sizes[long]
            if grams is not None:
                grams = np.append(grams, np.zeros(len(stay) - len(grams), np.uint64))[stay][:len(t) - size + 1]
        if grams is None:
            grams = _mixed(t.astype(np.uint64), t.astype(np.uint64) + np.uint64(1))
        while size < k:
            grams = _mixed(grams[:-size], grams[size:])
            size *= 2
        place, lag, follow = _seeds(grams, k, scale)
        centre = place + k // 2  # inside the run, even where a cluster goes beyond it
        ok = _plausible(grams, k, centre, lag)
        seeds = list(zip(lag[ok].tolist(), centre[ok].tolist()))
        if len(follow):
            seeds = sorted([*seeds, *[(q, m) for x in follow.tolist() for m, q in _across(t, *x, scale)]])
        last_q, last_end = 0, -1
        for q, m in seeds:
            if q == last_q and m < last_end or t[m] != t[m + q]:
                continue
            a, b = _extent(t, m, q)
            last_q, last_end = q, b
            if b - a >= max(q, least - q):
                out.append((int(where[a]), int(where[b - 1]) + 1 + q, q))
        scale, k = 2 * scale, 2 * k
    return out


def runs_of(t: np.ndarray, ends: np.ndarray, least: int = LEAST, direct: int = DIRECT) -> list[tuple[int, int, int]]:
    """Sorted (start, end, smallest period) of all runs of texts side by side; each text's last number is its own."""
    if direct < 8 or direct & (direct - 1):
        raise ValueError("direct is a power of two, 8 or more")
    best: dict[tuple[int, int], int] = {}
    for a, b, q in [*_direct(t, direct, least), *_by_scales(t, ends, direct, least)]:
        if q < best.get((a, b), q + 1):
            best[a, b] = q
    return sorted((a, b, q) for (a, b), q in best.items())


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The contract's rewriting: for each word the place of the word that stands there, None where all stay."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


class Lot:
    """Words of some texts side by side, their numbers, and the runs."""

    def __init__(self, texts: list[str | None], rewrites: list | None, least: int, direct: int):
        words = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.string()))
        flat, sizes = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # blanks at a text's ends give empty words
        doc = np.repeat(np.arange(len(texts)), sizes)[full]
        self.flat = flat.filter(pa.array(full))
        self.sizes = np.bincount(doc, minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.take = np.arange(len(doc))
        for d, rewrite in enumerate(rewrites or []):
            if rewrite is not None and (moved := planted(int(self.sizes[d]), rewrite)) is not None:
                self.take[self.starts[d]:self.starts[d] + len(moved)] = self.starts[d] + moved
        number = self.flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
        ends = np.cumsum(self.sizes + 1)  # with a number of its own after each text
        t = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        t[ends - 1] = -1 - np.arange(len(ends))
        at = np.arange(len(doc)) + doc
        t[at] = number[self.take]
        self.doc = doc
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        gone = np.zeros(len(t), np.int32)
        for a, b, q in runs_of(t, ends, least, direct):
            d = int(np.searchsorted(ends, a, side="right"))
            self.runs[d].append((a - int(ends[d] - self.sizes[d] - 1), b - a, q))
            gone[a + q] += 1
            gone[b] -= 1
        self.kept = np.cumsum(gone)[at] == 0

    def collapsed(self) -> list[str]:
        """The words that stay, joined by one space."""
        held = self.flat.take(pa.array(self.take[self.kept]))
        bounds = np.append(0, np.cumsum(np.bincount(self.doc[self.kept], minlength=len(self.sizes))))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), held), " ").to_pylist()


def lots(texts: list[str | None], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST, direct: int = DIRECT,
              plant: bool = False) -> DataFrame:
    """``row`` (the kept columns), n_words, the runs of every text by start and period, and the text without the words
    that repeat a run's first period.  ``plant`` first rewrites the texts that the contract names."""
    keep = docs.columns if keep is None else keep
    reads = ["text", "doc_id"] if plant else ["text"]

    def start():
        def fn(texts, ids=None):
            out: dict[str, list] = {"n_words": [], "runs": [], "collapsed": []}
            for a, b in lots(texts):
                lot = Lot(texts[a:b], ids[a:b] if ids else None, least, direct)
                out["n_words"] += lot.sizes.tolist()
                out["runs"] += [[{"start": s, "length": n, "period": q} for s, n, q in sorted(r, key=lambda x: (x[0], x[2]))] for r in lot.runs]
                out["collapsed"] += lot.collapsed()
            return out
        return fn
    return attach(docs, keep, reads, RUNS, start)


def collapse(docs: DataFrame, least: int = LEAST, direct: int = DIRECT) -> DataFrame:
    """The documents, their runs cut to one period where there is one.  Texts without runs stay as they are."""
    found = find_runs(docs, least=least, direct=direct)
    return with_text(found.select("row", F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row.text")).alias("new_text")), docs)


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest per document."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    # the greatest length, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return find_runs(docs, ["doc_id"], plant=True).select(F.col("row.doc_id").alias("doc_id"), "runs", "collapsed", best.alias("b"), lines.alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"), F.expr("1000 * b.length div -b.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
