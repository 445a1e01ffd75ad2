"""Best-fit packing by patterns of document lengths.

The plan looks at nothing but the histogram of lengths, of at most `capacity` entries: it
enumerates patterns of up to three lengths that fill a sequence exactly, fits their repeat counts
to the histogram by non-negative least squares, rounds them down and packs what remains by
best fit decreasing, in runs of equal sequences. Its size follows the capacity, not the corpus.

Pieces take their places by rank among the pieces of their length. Ranks come from counts of
(length, bucket) and an order within each bucket, so that no length, however common, meets in one
task; pieces that fill a sequence alone need no rank.

A document is its tokens and a closing token; null and empty texts are the closing token alone.
Documents longer than the capacity are cut into pieces of it, of which the last may be shorter.
Equal rows are packed once each; ties in rank have equal ids and any order among them gives a
valid packing. Rows of an empty table give none. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Texts of these characters alone are cut into words here, by the tokenizer's own rule for them.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-įı-ňŊ-ſ]*")
#: What a byte of such a text in lower case is: 0 white or an end, 1 letter, 2 digit, 3 other. Its wide characters are letters.
_KIND = np.array([0 if b in b"\0\t\n\r " else 1 if b >= 128 or 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.uint8)
#: Bytes of text that are cut into words at once, up to white space.
WINDOW = 1 << 18
#: Places of the table of words, words in it at most, and ids that a worker remembers: 24 bytes a place and 4 an id.
PLACES, REMEMBERED, IDS = 1 << 20, 700_000, 1 << 22
#: Places that a word may take from its own on; and words of over 16 bytes, or without a place, that are remembered apart.
PROBES, APART = 8, 20_000
#: The lowest n bytes of a 64-bit integer.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes of plain texts in lower case, as the pre-tokenizer's split pattern finds them:
    's|'t|'re|'ve|'m|'ll|'d, runs of letters, single digits and runs of anything else that is not white."""
    kind = np.zeros(len(raw) + 2, np.uint8)
    _KIND.take(raw, out=kind[1:-1])
    edge = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    starts, ends = edge & (kind[1:] > 0), edge & (kind[:-1] > 0)
    at = np.flatnonzero(raw == 39)
    at = at[starts[at] & (kind[at + 2] == 1)]  # an apostrophe before a letter that no run of others holds
    if len(at):
        one = raw[at + 1]
        two = raw[np.minimum(at + 2, len(raw) - 1)]
        short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
        long = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))
        for own, n in ((at[short], 2), (at[long & (kind[at + 3] == 1)], 3)):
            starts[own + 1] = ends[own + 1] = False
            starts[own + n] |= kind[own + n + 1] == 1
            ends[own + n] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit integers, by the file's tokenizer.

    Its words are encoded one by one, so ids of known words are remembered: words of up to 16 bytes by
    these bytes in a table that is probed for all words of a window together, others in a dictionary.
    Texts with characters outside a plain set go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The model's character for each byte.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.wide = {ch: level.pre_tokenize_str(ch)[0][0] for ch in map(chr, range(128, 384))}
        self.low, self.high, self.value = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.low[:] = 0
        self.ids = np.zeros(1 << 16, "<u4")
        self.used = self.held = 0
        self.apart: dict[bytes, tuple[int, int]] = {}

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new words begin, and their number."""
        tokenize, ids, counts = self.model.tokenize, [], []
        for word in new:
            text = word.decode()
            if not text.isascii():
                text = "".join(map(self.wide.get, text, text))
            own = tokenize(text)
            counts.append(len(own))
            ids += [t.id for t in own]
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(end, 2 * len(self.ids)) - self.used, "<u4")])
        self.ids[self.used : end] = ids
        count = np.array(counts, np.int64)
        begin = self.used + np.cumsum(count) - count
        self.used = end
        return begin, count

    def _remember(self, low: np.ndarray, high: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Puts words in the table; which of them found no place."""
        todo = np.arange(len(low))
        for _ in range(PROBES):
            at = place[todo]
            free = todo[self.low[at] == 0]
            self.value[place[free]] = value[free]
            free = free[self.value[place[free]] == value[free]]  # one of those that meet has the place
            self.low[place[free]], self.high[place[free]] = low[free], high[free]
            self.held += len(free)
            left = np.ones(len(low), bool)
            left[free] = False
            todo = todo[left[todo]]
            if not len(todo):
                break
            place[todo] = (place[todo] + 1) % PLACES
        return todo

    def _window(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a window's words one after another, where the words start and where their ids end."""
        starts, ends = word_bounds(raw)
        if self.held > REMEMBERED or self.used > IDS:
            self._forget()
        elif len(self.apart) > APART:
            self.apart.clear()
        length = ends - starts
        eight = np.ndarray((len(raw) + 8,), "<u8", np.concatenate([raw, np.zeros(15, np.uint8)]), strides=(1,))
        low = eight.take(starts) & _LOW.take(np.minimum(length, 8))
        more = np.flatnonzero(length > 8)
        high = np.zeros(len(low), np.uint64)
        high[more] = eight.take(starts[more] + 8) & _LOW.take(np.minimum(length[more] - 8, 8))
        place = low ^ high * np.uint64(0x9E3779B97F4A7C15)
        place ^= place >> np.uint64(29)
        place = (place * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) % PLACES
        first = place.copy()
        same = (self.low.take(place) == low) & (self.high.take(place) == high) & (length <= 16)
        value = np.where(same, self.value.take(place), 0)
        todo = np.flatnonzero(~same & (length <= 16) & (self.low.take(place) != 0))
        for _ in range(PROBES - 1):
            if not len(todo):
                break
            place[todo] = at = (place[todo] + 1) % PLACES
            held = self.low[at]
            same = (held == low[todo]) & (self.high[at] == high[todo])
            value[todo[same]] = self.value[at[same]]
            todo = todo[~same & (held != 0)]
        begin, count = value >> 5, value & 31
        unknown = np.flatnonzero(value == 0)
        if len(unknown):
            text = raw.tobytes()
            words = [text[s:e] for s, e in zip(starts[unknown].tolist(), ends[unknown].tolist(), strict=True)]
            new = {w: n for w, n in zip(words, unknown.tolist(), strict=True) if w not in self.apart}
            where = np.fromiter(new.values(), np.int64, len(new))
            found = self._learn(list(new))
            own = dict(zip(new, zip(*(x.tolist() for x in found), strict=True), strict=True))
            here = np.array([own.get(w) or self.apart[w] for w in words], np.int64)
            begin[unknown], count[unknown] = here[:, 0], here[:, 1]
            small = length[where] <= 16  # of at most 16 ids
            n = where[small]
            homeless = n[self._remember(low[n], high[n], first[n], begin[n] << 5 | count[n])]
            for k in np.concatenate([where[~small], homeless]).tolist():
                self.apart[text[starts[k] : ends[k]]] = int(begin[k]), int(count[k])
        end = np.cumsum(count)
        at = np.repeat(begin - (end - count), count)
        at += np.arange(len(at))
        return self.ids.take(at), starts, end

    def _plain(self, texts: list[str]) -> list[bytes]:
        raw = "\0".join([*(t.lower() for t in texts), ""]).encode()
        buffer, at, base = np.frombuffer(raw, np.uint8), 0, 0
        ids, closes = [], []
        while at < len(raw):
            end = len(raw)
            if end - at > WINDOW:
                white = np.flatnonzero(_KIND.take(buffer[at : at + WINDOW]) == 0)
                end = at
                while not len(white):  # a word longer than a window
                    end += WINDOW
                    white = np.flatnonzero(_KIND.take(buffer[end : end + WINDOW]) == 0)
                end += int(white[-1]) + 1
            own = buffer[at:end]
            found, starts, ends = self._window(own)
            ids.append(found)
            closes.append(base + np.append(0, ends)[np.searchsorted(starts, np.flatnonzero(own == 0))])
            base, at = base + len(found), end
        whole = np.concatenate(ids).astype("<u4", copy=False).tobytes() if ids else b""
        closes = [0, *np.concatenate(closes).tolist()] if closes else [0]
        return [whole[4 * a : 4 * b] for a, b in zip(closes, closes[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        plain = [bool(_PLAIN.fullmatch(t)) and not ("<|" in t and any(s in t for s in self.special)) for t in texts]
        own = iter(self._plain([t for t, p in zip(texts, plain, strict=True) if p]))
        whole = [t for t, p in zip(texts, plain, strict=True) if not p]
        rest = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)) if whole else iter(())
        return [next(own) if p else np.array(next(rest).ids, "<u4").tobytes() for p in plain]


PIECES = "piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document's pieces; with_ids also the ids as bytes."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    close = np.zeros(1, "<u4").tobytes()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = common.held(f"tokenizer {tokenizer}", lambda: WordTokenizer(tokenizer))  # later tasks know the words of earlier ones
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, number, start, length, crc, ids = [], [], [], [], [], []
                for n, raw in enumerate(words.encode(part["t"].to_pylist())):
                    raw += close
                    for p, begin in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[begin : begin + 4 * capacity]
                        row.append(n)
                        number.append(p)
                        start.append(begin // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                # Keys stay in Arrow: pandas would turn those beside a null into floats.
                out = [part["k"].take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
                names = ["k", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.binary())] if with_ids else out, [*names, "ids"] if with_ids else names)
            common.trim()

    return rows.mapInArrow(make, f"k {kind}, {PIECES}{', ids binary' if with_ids else ''}")


#: Largest capacity of a plan: all its patterns, about capacity**2 / 12, are held at once.
MOST_CAPACITY = 16_384


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """(n, 3) lengths, in falling order and 0 for none, of all sets of up to three documents that fill a sequence."""
    if capacity > MOST_CAPACITY:
        raise ValueError(f"plans reach up to a capacity of {MOST_CAPACITY}")
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    a = np.flatnonzero(have[: capacity])
    a = a[a >= (capacity + 1) // 2]
    two = a[have[capacity - a]]
    out.append(np.stack([two, capacity - two, 0 * two], axis=1))
    for x in range(capacity - 2, capacity // 3 - 1, -1):
        if not have[x]:
            continue
        rest = capacity - x
        y = np.arange(max(1, (rest + 1) // 2), min(x, rest - 1) + 1)
        y = y[have[y]]
        y = y[have[rest - y]]
        out.append(np.stack([0 * y + x, y, rest - y], axis=1))
    return np.concatenate(out)


def fit(shapes: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that nearly minimise |Ax - h|, A counting lengths in patterns.

    Multiplicative updates x <- x * (A'h) / (A'Ax) keep x non-negative and never raise the error.
    Leftover documents that are long cost more, so rows are weighted by length.
    """
    capacity = len(histogram) - 1
    weight = np.sqrt(np.arange(capacity + 1) / capacity)
    weight[0] = 0
    h = histogram * weight * weight
    x = np.full(len(shapes), max(1.0, histogram.sum()) / max(1, len(shapes)))
    top = h[shapes].sum(axis=1)
    for _ in range(steps):
        y = np.bincount(shapes.ravel(), np.repeat(x, 3), capacity + 1) * weight * weight
        x *= top / np.maximum(y[shapes].sum(axis=1), 1e-12)
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that pack all documents of a histogram of lengths (entry 0 unused)."""
    left = histogram.astype(np.int64).copy()
    capacity, out = len(left) - 1, []
    lengths = np.flatnonzero(left[:-1])
    if left[-1]:
        out.append(((capacity,), int(left[-1])))
        left[-1] = 0
    shapes = patterns(lengths, capacity) if len(lengths) else np.zeros((0, 3), int)
    if len(shapes):
        # Systematic rounding: along the patterns in order, each partial sum is rounded down, so that sums over
        # neighbouring patterns, and with them the counts of each longest length, stay within one of the fit.
        repeats = np.diff(np.floor(np.cumsum(fit(shapes, left)) + 0.5), prepend=0).astype(np.int64)
        for p in np.flatnonzero(repeats).tolist():
            used = [int(v) for v in shapes[p] if v]
            n = min(int(repeats[p]), *(int(left[v]) // used.count(v) for v in used))
            if n > 0:
                out.append((tuple(used), n))
                for v in used:
                    left[v] -= n
    return out + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram, placing runs of equal documents into runs of equal open sequences."""
    capacity = len(left) - 1
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by room left
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = int(fitting[0]) + length
                held, many = next(iter(open_[room].items()))
                fits = 1  # of a run into one sequence: best fit puts the next one there as well while no room is tighter
                move = min(many, n)
                del open_[room][held]
                if many > move:
                    open_[room][held] = many - move
                rooms[room] = bool(open_[room])
            else:
                room, held, fits = capacity, (), max(1, min(capacity // length, n))
                move = n // fits
            now = held + (length,) * fits
            rest = room - length * fits
            open_[rest][now] = open_[rest].get(now, 0) + move
            rooms[rest] = rest > 0
            n -= move * fits
    return [(held, n) for own in open_ for held, n in own.items()]


def placements(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """The plan by length: sorted (length << 40 | first rank) with the sequence of that rank and the offset there."""
    used = np.zeros(capacity + 1, np.int64)
    keys, sequences, offsets, first = [], [], [], 0
    for shape, n in planned:
        at = 0
        for length in shape:
            keys.append((length << 40) + int(used[length]))
            sequences.append(first)
            offsets.append(at)
            used[length] += n
            at += length
        first += n
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = 2048,
    with_ids: bool = False, rows_per_bucket: int = 1000, most_buckets: int = 4096,
) -> DataFrame:
    """Pieces of all documents with the sequence and offset each one takes."""
    spark = docs.sparkSession
    path = tokenizer or common.tokenizer_path("word_bpe_49k.json")
    cut = common.cut(pieces(docs, key, text, path, capacity, with_ids), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    buckets = min(most_buckets, max(1, int(histogram[:-1].sum()) // rows_per_bucket))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("k", "piece"), F.lit(buckets)).cast("int"))
    sent = spark.sparkContext.broadcast(placements(plan(histogram), capacity))
    # Ranks: those of smaller buckets come first. At most capacity x buckets counts.
    short = F.col("length") < capacity
    counts = cut.filter(short).groupBy("length", "bucket").count()
    own = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(own)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets = sent.value
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy(np.int64) - (keys[at] & ((1 << 40) - 1)), "offset": offsets[at]})

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("k", "piece", "ids_crc32")
    ranked = cut.filter(short).withColumn("own", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])
    names = [c for c in cut.columns if c not in ("k", "bucket")]
    ranked = ranked.withColumn("_p", place("length", F.col("own") + F.col("base")))
    placed = ranked.select("k", *names, "_p.sequence_id", "_p.offset")
    # A piece that fills a sequence: the plan's first sequences are these.
    total = int(histogram[-1])
    full = cut.filter(~short).withColumn("sequence_id", F.lit(-1) - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    out = placed.unionByName(full.select("k", *names, "sequence_id", "offset")) if total else placed
    return out.withColumn("length", F.col("length").cast("long")).withColumnRenamed("k", key)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    packed = pack(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
