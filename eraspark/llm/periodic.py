"""Periodic runs of words, by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same) that is at least ``max(min_length, min_repeats * q)`` words long
and that no neighbouring word extends.

Every word of a run comes back in it at least ``min_repeats`` times. So a word
that is rarer than that within a segment belongs to no run there: it cuts the
segment in two, within which more words are too rare, and so on until nothing
changes; segments under ``min_length`` words go as well. Most prose falls
apart in a few rounds. What survives is scanned by lags: a run of period p is a
stretch of at least ``max(min_length, min_repeats * p) - p`` positions i with
word i = word i + p, so one position in that many is looked at (an anchor), and
from those that match the stretch is followed to both ends. All lags between two
powers of two are scanned at once; lag p costs n / p looks, all lags n log n.

A text is one row and is judged by itself, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import slices

MIN_LENGTH = 24
MIN_REPEATS = 3

#: So many further words are compared before a stretch is followed to its ends.
_LOOK = 8
#: Comparisons made in one array operation.
_CHUNK = 1 << 20


def find_runs(df: DataFrame, text: str = "text", min_length: int = MIN_LENGTH,
              min_repeats: int = MIN_REPEATS) -> DataFrame:
    """``df`` with ``runs`` (array of struct start, length, period, numbered in
    words from 0, by start, then period) and ``collapsed``: the words of the text
    joined by one space, without those that some run contains after its first
    period.

    Words are what ASCII white space (blank, tab to carriage return) leaves.
    Null and blank texts have no run and collapse to the empty text. Rows are
    judged one by one, so equal rows get equal results and an empty table gives
    an empty one. Columns named ``runs`` or ``collapsed`` are replaced. A text is
    handled whole, however long: a worker holds some 60 bytes a word of it.
    """
    if min_repeats < 2 or min_length < 2:
        raise ValueError("a run has at least two words and repeats at least twice")
    keep = [c for c in df.columns if c not in ("runs", "collapsed")]
    if text not in keep:
        raise ValueError(f"no column {text!r} to read, or one that the result replaces")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    schema = f"{kinds}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

    def judge(batches):
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, text):
                runs, collapsed = _judged(part.column(keep.index(text)), min_length, min_repeats)
                yield pa.RecordBatch.from_arrays([*part.columns, runs, collapsed], [*keep, "runs", "collapsed"])
    return df.select(*keep).mapInArrow(judge, schema)


def _judged(texts, min_length: int, min_repeats: int):
    """The Arrow columns (runs, collapsed) of a column of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[real]
    words = words.filter(pa.array(real))
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start, length, period = runs_of(ids, doc, min_length, min_repeats)

    ends = np.zeros(len(ids) + 1, np.int64)              # words dropped, as openings and closings
    np.add.at(ends, start + period, 1)
    np.add.at(ends, start + length, -1)
    kept = np.cumsum(ends)[:-1] == 0
    counts = np.bincount(doc[kept], minlength=len(lists))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(_offsets(counts), words.filter(pa.array(kept))), " ")

    first = _offsets(np.bincount(doc, minlength=len(lists)))[:-1]
    of = doc[start]
    fields = [pa.array(x.astype(np.int64)) for x in (start - first[of], length, period)]
    runs = pa.ListArray.from_arrays(_offsets(np.bincount(of, minlength=len(lists))),
                                    pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return runs, collapsed


def _offsets(counts):
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def runs_of(ids, doc, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS):
    """(start, length, period) of all runs, by start, then period; ``ids`` are
    the words of several documents one after the other, ``doc`` their documents
    in ascending order; start counts from the first word of the first."""
    place, segment = split_by_frequency(ids, doc, min_length, min_repeats)
    found = _lag_scan(ids[place], segment, min_length, min_repeats)
    found = np.array(sorted((int(place[s]), e - s, p) for s, e, p in found), np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def split_by_frequency(ids, doc, min_length: int, min_repeats: int):
    """(positions that survive, their segments from 0). A segment is a stretch
    of one document in which every word occurs ``min_repeats`` times or more."""
    place, segment = np.arange(len(ids)), np.asarray(doc, np.int64)
    kinds = int(ids.max()) + 1 if len(ids) else 1
    while len(place):
        long = np.bincount(segment)[segment] >= min_length
        place, segment = place[long], segment[long]
        _, which, count = np.unique(segment * kinds + ids[place], return_inverse=True, return_counts=True)
        often = count[which] >= min_repeats if len(place) else np.ones(0, bool)
        settled = bool(often.all())
        place, segment = place[often], segment[often]
        cut = np.ones(len(place), bool)
        cut[1:] = (np.diff(place) != 1) | (np.diff(segment) != 0)
        segment = np.cumsum(cut) - 1
        if settled:
            break
    return place, segment


def _lag_scan(w, segment, min_length: int, min_repeats: int):
    """[start, end, period] of all runs within the segments of ``w``."""
    if not len(w):
        return []
    lengths = np.bincount(segment)
    begins = np.cumsum(lengths) - lengths
    found: list[tuple[int, int, int]] = []
    low = 1
    while True:
        some = lengths >= max(min_length, min_repeats * low)
        if not some.any():
            return found
        lags = np.arange(low, 2 * low)
        step = int((np.maximum(min_length, min_repeats * lags) - lags).min())
        anchors, ends = _anchors(begins[some], lengths[some], low, step)
        shorter = list(found)                           # runs of periods under this block's
        each = max(1, _CHUNK // low)
        for lo in range(0, len(anchors), each):
            a, p, e = _matching(w, anchors[lo:lo + each], ends[lo:lo + each], lags)
            a, p, e = _look_around(w, segment, a, p, e, step)
            a, p, e = _unexplained(shorter, a, p, e)
            order = np.lexsort((a, p))
            _follow(w, begins[segment[a[order]]], a[order], p[order], e[order], min_length, min_repeats, found)
        low *= 2


def _anchors(begins, lengths, low: int, step: int):
    """Every ``step``-th position of each segment that has one ``low`` further on; the segments' ends."""
    counts = (lengths - low - 1) // step + 1
    which = np.repeat(np.arange(len(begins)), counts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    return begins[which] + nth * step, (begins + lengths)[which]


def _matching(w, anchors, ends, lags):
    """(anchor, lag, end of segment) of the anchors whose word returns at the lag."""
    there = anchors[:, None] + lags[None, :]
    inside = there < ends[:, None]
    same = (w[np.minimum(there, len(w) - 1)] == w[anchors][:, None]) & inside
    i, j = np.nonzero(same)
    return anchors[i], lags[j], ends[i]


def _look_around(w, segment, a, p, e, step: int):
    """Those that go on matching: a stretch of ``step`` positions has half of
    them at or after its anchor, or half before it."""
    right, left = np.ones(len(a), bool), np.ones(len(a), bool)
    last = len(w) - 1
    for k in range(1, min(_LOOK, (step + 1) // 2)):
        right &= (a + k + p < e) & (w[np.minimum(a + k, last)] == w[np.minimum(a + k + p, last)])
    for k in range(1, min(_LOOK, step // 2) + 1):
        b = np.maximum(a - k, 0)
        left &= (a >= k) & (segment[b] == segment[a]) & (w[b] == w[b + p])
    on = right | left
    return a[on], p[on], e[on]


def _unexplained(runs, a, p, e):
    """Without the matches within a run whose period divides the lag: a
    stretch of the longer period that covers one has the shorter period too."""
    if runs and len(a):
        order = np.argsort(a, kind="stable")
        a, p, e = a[order], p[order], e[order]
        open_ = np.ones(len(a), bool)
        for s, t, q in runs:
            i, j = np.searchsorted(a, (s, t))
            open_[i:j] &= ~((a[i:j] + p[i:j] < t) & (p[i:j] % q == 0))
        a, p, e = a[open_], p[open_], e[open_]
    return a, p, e


def _follow(w, begins, a, p, e, min_length, min_repeats, found) -> None:
    """Follow each match to the ends of its stretch; add the new runs to ``found``."""
    known = set(found)
    lag = reached = -1
    for b, x, q, end in zip(begins.tolist(), a.tolist(), p.tolist(), e.tolist()):
        if q == lag and x < reached:
            continue
        s, t = _backward(w, x, q, b), _forward(w, x, q, end)
        lag, reached = q, t
        run = (s, t + q, q)
        if run[1] - s >= max(min_length, min_repeats * q) and run not in known:
            known.add(run)
            found.append(run)


def _forward(w, x: int, q: int, end: int) -> int:
    """The first position after x that does not match the one q further on."""
    size = 64
    while x < end - q:
        stop = min(x + size, end - q)
        off = np.flatnonzero(w[x:stop] != w[x + q:stop + q])
        if len(off):
            return x + int(off[0])
        x, size = stop, size * 2
    return x


def _backward(w, x: int, q: int, begin: int) -> int:
    """The first of the positions up to x that all match."""
    size = 64
    while x > begin:
        stop = max(x - size, begin)
        off = np.flatnonzero(w[stop:x] != w[stop + q:x + q])
        if len(off):
            return stop + int(off[-1]) + 1
        x, size = stop, size * 2
    return x
