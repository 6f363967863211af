"""Runs of words that repeat with a period, found by recursive frequency splitting.

A run is a maximal stretch of words with smallest period q whose length is at least ``least`` and at least ``times`` q. Each of
its words occurs at least ``times`` times in it, so a word that occurs less often within a segment of the text is in no
run there: it splits the segment. The parts are counted anew until nothing splits, and parts that are too short go.

What survives is scanned by lags. A run of period q holds at least three multiples of q in a row at which the word
repeats q words later, one of them a multiple of 3q; so only those are looked up, n/3q for a lag, and the few that
meet the condition are stretched to both sides as far as words repeat. A stretch whose period is not its smallest equals a run
that a lag dividing it has found before. Time is n log n for n words in segments, whatever the text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import split_words

#: Shortest run, and how often at least its period fits into it.
LEAST, TIMES = 6, 4
#: Lags of a segment that are looked up at a time have about so many multiples.
LOOKUPS = 1 << 20


def word_codes(words: list) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: defaultdict = defaultdict()
    seen.default_factory = seen.__len__
    return np.array(list(map(seen.__getitem__, words)), dtype=np.int64)


def segments(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the parts in which every word occurs at least ``times`` times; a run lies in one of them."""
    place = np.arange(len(codes))
    part = np.zeros(len(codes), dtype=np.int64)
    done: list[tuple[int, int]] = []
    while len(place):
        # words of the same part and code
        key = part * (int(codes.max()) + 1) + codes[place]
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        rare = counts[which] < times
        # a part without rare words is stable; only those that split are counted again
        split = np.zeros(int(part[-1]) + 1, dtype=bool)
        split[part[rare]] = True
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        end = np.append(begin[1:], len(part))
        done += [(int(place[b]), int(place[e - 1]) + 1) for b, e in zip(begin, end, strict=True) if not split[part[b]]]
        stay = split[part] & ~rare
        place, part = place[stay], part[stay]
        if len(place):
            part = np.cumsum((np.diff(place, prepend=place[0]) > 1) | (np.diff(part, prepend=part[0]) != 0))
            long = np.bincount(part)[part] >= least
            place, part = place[long], part[long]
            if len(part):
                part = np.cumsum(np.diff(part, prepend=part[0]) != 0)
    return sorted(s for s in done if s[1] - s[0] >= least)


def _stretch(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """First and one past the last place around ``at`` from which on all words repeat ``lag`` words later."""
    end, step = at, 16
    limit = len(codes) - lag
    while end < limit:
        same = codes[end : min(end + step, limit)] == codes[end + lag : min(end + step, limit) + lag]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = end + len(same), 2 * step
    begin, step = at, 16
    while begin > 0:
        low = max(0, begin - step)
        same = (codes[low:begin] == codes[low + lag : begin + lag])[::-1]
        if not same.all():
            begin -= int(same.argmin())
            break
        begin, step = low, 2 * step
    return begin, end


def _anchors(codes: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int]]:
    """(lag, place) for lags first .. last: places 3k * lag in three repeats in a row, by lag and place."""
    n = len(codes)
    lags = np.arange(first, last + 1)
    counts = (n - lags - 1) // (3 * lags) + 1
    lag = np.repeat(lags, counts)
    place = (np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)) * 3 * lag
    hit = codes[place] == codes[place + lag]
    lag, place = lag[hit], place[hit]

    def repeats(k: int) -> np.ndarray:
        """Whether the word k lags further on repeats as well."""
        at = place + k * lag
        inside = (at >= 0) & (at + lag < n)
        at = np.where(inside, at, 0)
        return inside & (codes[at] == codes[np.where(inside, at + lag, 0)])

    after, before = repeats(1), repeats(-1)
    hit = (after & (before | repeats(2))) | (before & repeats(-2))
    return zip(lag[hit].tolist(), place[hit].tolist(), strict=True)


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. ``times`` is at least 4."""
    if times < 4 or least < 1:
        raise ValueError("runs repeat their period four times or more")
    found = []
    for begin, end in segments(codes, least, times):
        found += [(begin + start, length, lag) for start, length, lag in _scan(codes[begin:end], least, times)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def _scan(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    n = len(codes)
    largest = n // times
    known: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and ends of its runs, ascending
    found: list[tuple[int, int, int]] = []
    first = 1
    while first <= largest:
        last, lookups = first, n // (3 * first) + 1
        while last < largest and lookups < LOOKUPS:
            last += 1
            lookups += n // (3 * last) + 1
        now, past, periods = 0, -1, []
        for lag, place in _anchors(codes, first, last):
            if lag != now:
                now, past, periods = lag, -1, [p for p in known if lag % p == 0]
            if place < past:
                continue
            if any(_inside(known[p], place, place + lag) for p in periods):
                continue
            begin, past = _stretch(codes, place, lag)
            length = past - begin + lag
            if length >= max(least, times * lag) and not any(_inside(known[p], begin, begin + length - 1) for p in periods):
                starts, ends = known.setdefault(lag, ([], []))
                starts.append(begin)
                ends.append(begin + length)
                found.append((begin, length, lag))
        first = last + 1
    return found


def _inside(runs: tuple[list[int], list[int]], begin: int, end: int) -> bool:
    """Whether one of the runs holds both places."""
    k = bisect_right(runs[0], begin) - 1
    # runs of one period overlap in less than it, so the one that starts last before a place, or the one before that, holds it
    return any(runs[1][j] > end for j in (k, k - 1) if j >= 0)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows with all their columns but ``text``, and n_words, runs (start, length, period; by start, then period), collapsed.

    Words are those of the whole text, numbered from 0; null counts as empty. ``collapsed`` are the words that stay, joined by one space:
    one is dropped if any run holds it after that run's first period. No words: no runs, an empty text. Rows are
    looked at one by one: repeated rows, equal or null ids and columns of any name but these three are passed on as they are.
    """
    kept = [c for c in docs.columns if c != text]
    if clash := {"n_words", "runs", "collapsed"} & set(kept):
        raise ValueError(f"columns that this adds: {sorted(clash)}")
    added = T.StructType().add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())
    # by place: names may repeat
    rows = docs.select(*kept, text)
    schema = T.StructType([*rows.schema.fields[:-1], *added.fields])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1000):  # what goes out at a time
                part = batch.slice(low, 1000)
                counts, runs, texts = [], [], []
                for body in part.column(part.num_columns - 1).to_pylist():
                    words = split_words(body)
                    here = runs_of(word_codes(words), least, times) if len(words) >= least else []
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
                    texts.append(b" ".join(collapsed(words, here)))
                columns = [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(runs, arrow), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(scan, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first, then that of the smallest period; null without runs."""

    def better(best, run):
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | ahead, run).otherwise(best)

    # runs ascend by start and period, so only a greater one replaces
    return F.aggregate(runs, F.lit(None).cast(RUN), better)
