"""Removing passages that occur earlier in the corpus, found by FM-indexes of its shards.

A window is so many consecutive words of a document. Shards are cut by content, so that a document is
streamed only against those in which its windows can occur again:

1. A window's anchor is the k-gram of words with the smallest hash in it. Equal windows have equal anchors. Consecutive windows with the
   anchor at the same place form a passage of fewer than twice the window's words. Only anchors that occur more than once can have
   windows that repeat; passages of all others are left where they are.
2. Passages of equal text are one from here on, at the earliest place, however many documents hold them.
3. A shard takes the passages of its anchors. It sorts their suffixes as deep as a window, keeps the Burrows-Wheeler transform
   in a wavelet matrix of packed bits, and streams its passages: every window is searched backward, word by word, for
   as long as more than one suffix matches. Windows that reach full length have an interval of suffixes each; its smallest
   place is the window's first occurrence, and every other one is reported.
4. What is reported goes back to the documents: words covered by a reported window go.

An anchor with very many different passages is cut into single windows, dealt out by their whole text, so no
shard grows with a frequent phrase.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch
from .common import bounded, keyed, split_words

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 20, 6
#: Words that a shard's index holds on average.
SHARD_WORDS = 500_000
#: Different passages of one anchor; with more they are dealt out by window.
MOST_PASSAGES = 4_000
_CHUNK = 1 << 16


class WaveletMatrix:
    """A sequence of small numbers as one packed bit vector a binary digit, with counts before every 64 bits."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)).view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` numbers end in the last level's node of ``symbol``."""
        for k in range(self.levels):
            block = at >> 6
            inside = self.bits[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.before[k][block] + np.bitwise_count(inside)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, ones + self.zeros[k], at - ones)
        return at


class FmIndex:
    """Backward search in a sequence of numbers from 0 to ``symbols`` - 1, for patterns of at most ``depth``.

    Suffixes are sorted by their first ``depth`` numbers at least (the sequence is read as a ring); suffixes equal that far are in no order.
    """

    def __init__(self, sequence: np.ndarray, symbols: int, depth: int):
        n = len(sequence)
        rank, step, largest = sequence.astype(np.int64), 1, symbols
        while True:
            key, ways = rank, 1
            while ways * step < depth and largest ** (ways + 1) < 1 << 63:  # as many ranks as one number holds
                key = key * largest + np.roll(rank, -ways * step)
                ways += 1
            if ways == 1 and step < depth:
                raise ValueError("a shard is too large to sort")
            step *= ways
            self.suffixes = np.argsort(key, kind="stable")
            if step >= depth:
                break
            key = key[self.suffixes]
            rank = np.empty(n, dtype=np.int64)
            rank[self.suffixes] = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
            largest = int(rank[self.suffixes[-1]]) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        self.matrix = WaveletMatrix(sequence[self.suffixes - 1], symbols)
        every = np.arange(symbols)
        self.shift = self.starts[:-1] - self.matrix.down(every, np.zeros(symbols, dtype=np.int64))

    def one(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that begin with a symbol."""
        return self.starts[symbol], self.starts[symbol + 1]

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before them."""
        shift = self.shift[symbol]
        return self.matrix.down(symbol, low) + shift, self.matrix.down(symbol, high) + shift


def first_windows(passages: list[bytes], place: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each passage, as bits by offset, which of its windows occur nowhere earlier in the passages.

    A passage has ``window`` words or more, with one space between them. ``place`` orders the passages' first words; a window's place is that
    plus its offset. Places are all different.
    """
    words = b" ".join(passages).split(b" ")
    sizes = np.array([text.count(b" ") for text in passages]) + 1
    seen: defaultdict = defaultdict()
    seen.default_factory = lambda: len(seen) + 1
    numbers = np.array(list(map(seen.__getitem__, words)), dtype=np.int64)
    del words
    begin = np.cumsum(sizes + 1) - sizes - 1
    whole = np.repeat(np.arange(len(passages)), sizes + 1)
    within = np.arange(len(whole)) - begin[whole]
    sequence = np.zeros(len(whole), dtype=np.int64)  # 0 ends a passage
    sequence[within < sizes[whole]] = numbers
    index = FmIndex(sequence, len(seen) + 1, window)
    # the place of every number of the sequence, in the order of the suffixes
    places = np.append((place[whole] + within)[index.suffixes], np.iinfo(np.int64).max)
    at = np.flatnonzero(within + window <= sizes[whole])
    offset, own = within[at], place[whole[at]] + within[at]
    earliest = np.ones(len(at), dtype=np.int64)
    for chunk in range(0, len(at), _CHUNK):
        which = np.arange(chunk, min(chunk + _CHUNK, len(at)))
        low, high = index.one(sequence[at[which] + window - 1])
        for back in range(window - 2, -1, -1):
            many = high - low > 1  # what matches one suffix only is its own
            which, low, high = which[many], low[many], high[many]
            low, high = index.back(sequence[at[which] + back], low, high)
        many = high - low > 1
        which, low, high = which[many], low[many], high[many]
        if len(which):
            # intervals of patterns of one length are equal or disjoint
            low, where, owner = np.unique(low, return_index=True, return_inverse=True)
            ends = np.stack([low, high[where]], axis=1).ravel()
            earliest[which] = np.minimum.reduceat(places, ends)[::2][owner] == own[which]
    return np.add.reduceat(earliest << offset, np.flatnonzero(offset == 0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, base, dtype=np.uint64)]), dtype=np.uint64)


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of the words in the bytes of texts; ``edges`` are the places between texts, with 0 and the end.

    A hash is a polynomial in the word's bytes, mixed: the difference of two prefix sums. Hashes only choose anchors, words decide.
    """
    apart = (data == 32) | ((data >= 9) & (data <= 13))
    begin, end = ~apart, ~apart
    begin[1:] &= apart[:-1]
    end[:-1] &= apart[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begin[inner] = ~apart[inner]
    end[inner - 1] = ~apart[inner - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = np.empty(len(begin), dtype=np.uint64)
    low = 0
    while low < len(begin):  # so many words at a time as fit a piece, one at least
        base = begin[low]
        high = max(low + 1, int(np.searchsorted(end, base + _PIECE, side="right")))
        some = data[base : end[high - 1]].astype(np.uint64) + np.uint64(1)
        powers = _POWERS if len(some) <= _PIECE else _powers(_BASE, len(some))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(some * powers[: len(some)], dtype=np.uint64)])
        first, last = begin[low:high] - base, end[low:high] - base
        inverse = _INVERSE if len(some) <= _PIECE else _powers(pow(_BASE, -1, 1 << 64), len(some))
        hashes[low:high] = (sums[last] - sums[first]) * inverse[first]
        low = high
    return begin, _mixed(hashes)


_PIECE = 1 << 18
_BASE = 0xD1342543DE82EF95
_POWERS, _INVERSE = _powers(_BASE, _PIECE), _powers(pow(_BASE, -1, 1 << 64), _PIECE)


def passages_of(codes: np.ndarray, text: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first word, windows) of the passages of texts, given their words' hashes and the text of each word."""
    if len(codes) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    grams = np.zeros(len(codes) - anchor + 1, dtype=np.uint64)
    for k in range(anchor):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + codes[k : k + len(grams)]
    grams = _mixed(grams)
    across = window - anchor + 1
    at = []
    for low in range(0, len(codes) - window + 1, _CHUNK):
        some = grams[low : low + _CHUNK + across - 1]
        # the hash with its place in the last bits, so that of equal ones the first is the least
        some = (some & np.uint64(0xFFFFFFFFFFFE0000)) | np.arange(len(some), dtype=np.uint64)
        reach = 1
        while 2 * reach <= across:
            some, reach = np.minimum(some[:-reach], some[reach:]), 2 * reach
        if reach < across:
            some = np.minimum(some[: reach - across], some[across - reach :])
        at.append((some & np.uint64(0x1FFFF)).astype(np.int64) + low)
    at = np.concatenate(at)
    whole = np.flatnonzero(text[: len(at)] == text[window - 1 :])  # windows in one text; no two texts share an anchor
    at = at[whole]
    start = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[start]].view(np.int64), whole[start], np.diff(np.append(start, len(at)))


_KEY = "_file long, _at long"
_PASSAGE = pa.schema([("_file", pa.int64()), ("_at", pa.int64()), ("anchor", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and the place of each text in them; null texts are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(window: int, anchor: int):
    """Passages of (key, text) rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = _bytes(batch.column(2))
            keys = [batch.column(k).to_numpy() for k in range(2)]
            low = 0
            while low < len(batch):  # texts of about a megabyte together, or one
                high = max(low + 1, int(np.searchsorted(edges, edges[low] + (1 << 20), side="right")) - 1)
                here = edges[low : high + 1] - edges[low]
                begin, codes = word_hashes(data[edges[low] : edges[high]], here)
                text = np.searchsorted(here, begin, side="right") - 1
                hashes, first, windows = passages_of(codes, text, window, anchor)
                row = text[first]
                start = first - np.searchsorted(begin, here[row])
                yield _batch([(*(k[low + row] for k in keys), hashes, start, windows)], _PASSAGE)
                low = high

    return scan


def _batch(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _texts(window: int):
    """(key, doc_id, anchor, start, text) of the passages wanted of (key, doc_id, text, anchors, starts, windows) rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                some = batch.slice(low, 500)
                texts, which, anchors, starts = [], [], [], []
                for k, (text, *wanted) in enumerate(zip(*(c.to_pylist() for c in some.columns[3:]), strict=True)):
                    words = split_words(text)
                    texts += [b" ".join(words[s : s + n + window - 1]) for s, n in zip(*wanted[1:], strict=True)]
                    anchors += wanted[0]
                    starts += wanted[1]
                    which += [k] * len(wanted[0])
                taken = [some.column(k).take(pa.array(which, pa.int64())) for k in range(3)]
                found = [pa.array(anchors, pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*taken, *found], names=["_file", "_at", "doc_id", "anchor", "start", "text"])

    return scan


_FIRST = pa.schema([("_file", pa.int64()), ("_at", pa.int64()), ("start", pa.int64()), ("first", pa.int64())])


def _search(window: int):
    """The windows of a shard that occur nowhere earlier, as bits by offset, from (text, _null, doc_id, _file, _at, start) rows."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(6)]
        for batch in batches:
            for held, column in zip(columns, batch.columns, strict=True):
                held += column.to_pylist()
        texts, *keys, start = columns
        if not texts:
            return
        documents = list(zip(*keys, strict=True))
        order = {d: k for k, d in enumerate(sorted(set(documents)))}
        place = np.array([order[d] for d in documents], dtype=np.int64) * (1 << 32) + np.array(start, dtype=np.int64)
        passages = [text.encode() for text in texts]
        del texts
        bits = first_windows(passages, place, window)
        some = np.flatnonzero(bits)
        parts = [(np.array(keys[2])[some], np.array(keys[3])[some], np.array(start)[some], bits[some])]
        yield _batch(parts, _FIRST)

    return shard


def _removed(n: int, starts: list[int], windows: list[int], kept: list[int], bits: list[int], window: int) -> np.ndarray:
    """Which of n words are covered by a window that is not the first of its words."""
    again = np.zeros(n, dtype=bool)
    for s, count in zip(starts, windows, strict=True):
        again[s : s + count] = True
    for s, first in zip(kept, bits, strict=True):
        while first:
            again[s] &= not first & 1
            first, s = first >> 1, s + 1
    change = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    change[at] += 1
    change[at + window] -= 1
    return np.cumsum(change)[:n] > 0


def _finish(window: int, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for low in range(0, len(batch), 500):
                some = batch.slice(low, 500)
                counts, gone, spans, kept = [], [], [], []
                for text, starts, *rest in zip(*(c.to_pylist() for c in some.columns[-5:]), strict=True):
                    words = split_words(text)
                    counts.append(len(words))
                    edge = []
                    if starts:
                        out = _removed(len(words), starts, *(x or [] for x in rest), window)
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], out, [0]]))).reshape(-1, 2).tolist()
                    gone.append(sum(b - a for a, b in edge))
                    spans.append([{"start": a, "end": b} for a, b in edge])
                    for a, b in reversed(edge):
                        del words[a:b]
                    kept.append(b" ".join(words))
                added = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns[:-5], *added], names=names)

    return scan


def repeating(passages: DataFrame, scratch: Scratch) -> DataFrame:
    """The passages whose anchor occurs more than once."""
    counts = scratch.table(passages.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("anchor", "_a"), "anchors")
    # at most a thousand anchors have a thousandth of all passages or more; all others are no hot keys
    often = max(2, passages.count() // 1000)
    hot = F.broadcast(counts.where(F.col("n") >= often).select("_a"))
    on = F.col("anchor") == F.col("_a")
    cold = passages.join(hot, on, "left_anti").join(bounded(counts.where(F.col("n") < often).select("_a")), on, "left_semi")
    return passages.join(hot, on, "left_semi").unionByName(cold)


def spread(distinct: DataFrame, scratch: Scratch, window: int, most: int) -> DataFrame:
    """(shard key, text, first): passages go by anchor; those of an anchor with more than ``most`` by window."""
    heavy = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("anchor").alias("_a"))
    heavy = scratch.table(heavy, "heavy")
    on = F.col("anchor") == F.col("_a")
    if heavy.isEmpty():
        return distinct.select(F.col("anchor").alias("key"), "text", "first")
    light = distinct.join(bounded(heavy), on, "left_anti").select(F.col("anchor").alias("key"), "text", "first")
    words = F.split("text", " ")
    each = distinct.join(bounded(heavy), on, "left_semi").select(
        F.col("first"), words.alias("_words"), F.explode(F.sequence(F.lit(0), F.size(words) - window)).alias("_k")
    )
    first = F.col("first").withField("start", F.col("first.start") + F.col("_k"))
    each = each.select(F.array_join(F.slice("_words", F.col("_k") + 1, window), " ").alias("text"), first.alias("first"))
    each = each.groupBy("text").agg(F.min("first").alias("first"))
    return light.unionByName(each.select(F.xxhash64("text", F.lit(3)).alias("key"), "text", "first"))


def drop_repeats(
    docs: DataFrame,
    scratch: Scratch,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    text: str = "text",
    doc_id: str = "doc_id",
    shard_words: int = SHARD_WORDS,
    most: int = MOST_PASSAGES,
) -> DataFrame:
    """The rows with all their columns but ``text``, and n_words, n_removed, removed (spans of words: start, end), kept.

    Removed is each word covered by a window of ``window`` words that also starts earlier: in a row of smaller ``doc_id``, or earlier in
    the same row. Rows that share a doc_id are ordered as they are stored; null ids come last. Windows are judged on
    the texts as given. ``kept`` are the words that stay, joined by one space. Null counts as empty; a text of fewer words than a
    window loses none. Columns may have any names but those four. No rows give no rows.
    """
    if not 0 < anchor <= window <= anchor + 61:
        raise ValueError("a passage has at most 62 windows, and an anchor fits a window")
    kept = [c for c in docs.columns if c != text]
    if clash := {"n_words", "n_removed", "removed", "kept"} & set(kept):
        raise ValueError(f"columns that this adds: {sorted(clash)}")
    plain = docs.select(*kept, text).toDF(*[f"c{k}" for k in range(len(kept))], "text")
    who = f"c{kept.index(doc_id)}"
    rows = keyed(plain, scratch)

    passages = scratch.table(rows.select("_file", "_at", "text").mapInArrow(_cut(window, anchor), f"{_KEY}, anchor long, start long, windows long"), "passages")
    path = scratch.paths[-1]
    wanted = repeating(passages, scratch).groupBy("_file", "_at").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("wanted"))
    wanted = scratch.table(wanted, "wanted")
    scratch.release(path)

    who_type = docs.schema[doc_id].dataType
    number = T.LongType()
    schema = T.StructType().add("_file", number).add("_at", number).add("doc_id", who_type).add("anchor", number).add("start", number)
    schema = schema.add("text", T.StringType())
    texts = rows.select("_file", "_at", F.col(who).alias("doc_id"), "text").join(wanted, ["_file", "_at"])
    texts = texts.select("_file", "_at", "doc_id", "text", "wanted.anchor", "wanted.start", "wanted.windows").mapInArrow(_texts(window), schema)
    first = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_file", "_at", "start")
    distinct = scratch.table(texts.groupBy("anchor", "text").agg(F.min(first).alias("first")), "distinct")
    shards = spread(distinct, scratch, window, most)
    total = distinct.agg(F.sum(F.size(F.split("text", " ")).cast("long"))).first()[0] or 0
    shards = shards.repartition(max(1, -(-total // shard_words)), "key")
    found = shards.select("text", "first._null", "first.doc_id", "first._file", "first._at", "first.start")
    found = scratch.table(found.mapInArrow(_search(window), f"{_KEY}, start long, first long"), "first")

    found = found.groupBy("_file", "_at").agg(F.collect_list(F.struct("start", "first")).alias("first"))
    marks = wanted.select("_file", "_at", F.col("wanted.start").alias("starts"), F.col("wanted.windows").alias("windows"))
    marks = marks.join(found, ["_file", "_at"], "left")
    rows = rows.join(marks, ["_file", "_at"], "left").select(*plain.columns, "starts", "windows", "first.start", "first.first")
    spans = T.ArrayType(T.StructType().add("start", number).add("end", number))
    added = T.StructType().add("n_words", number).add("n_removed", number).add("removed", spans).add("kept", T.StringType())
    schema = T.StructType([*plain.schema.fields[:-1], *added.fields])
    return rows.mapInArrow(_finish(window, schema.names), schema).toDF(*kept, *added.names)
