"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table, dealt by document: a row holds a segment of some 130,000 words, with its
terms, their postings (positions in the segment, as gaps) and the documents' places. No posting list crosses
the network and no term or source can be hot. It is made once and may be asked any number of times; no
question reads the texts again.

Test items come in blocks of bounded size, each one broadcast. In a segment each window of an item is
represented by its rarest term there: the lists of these terms, shifted by their offsets, give the places
where a window can begin at all, each place once however many windows there are. At these the lists of the other
terms are intersected, a term at a time, and what is left is looked up among the windows and compared term by
term. Work is thus bounded by the postings, not by documents times windows. Phrase matches are exact; proximity
matches want all terms in order within a span.

Null and empty texts have no words, no hits, and are clean. Items without words or id take no
part; items that share an id are one item. Repeated rows are judged each for itself. A document longer than a
segment is a segment of its own. Columns other than the named ones are ignored by `judge` and kept by `keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Words in a segment of the index; a longer document is a segment of its own.
SEGMENT_WORDS = 1 << 17
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 4 << 20


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Group:
    """The different windows of one size, as term numbers, with their items; found by a hash that parts them."""

    def __init__(self, windows: np.ndarray, items: np.ndarray):
        self.size, base = windows.shape[1], 0x9E3779B97F4A7C15
        while True:
            self.powers = _powers(self.size, base)
            _, first, which = np.unique(self.hashes(windows.T), return_index=True, return_inverse=True)
            if (windows[first][which] == windows).all():
                break
            base = (base * 6364136223846793005 + 1442695040888963407 | 1) % (1 << 64)  # two windows shared a hash
        self.windows = windows[first]  # in order of their hashes
        self.sorted = self.hashes(self.windows.T)
        pairs = np.unique(which.astype(np.int64) << 32 | items)
        self.items = pairs & 0xFFFFFFFF
        self.offsets = np.searchsorted(pairs >> 32, np.arange(len(first) + 1))

    def hashes(self, columns) -> np.ndarray:
        total = np.uint64(0)
        for power, own in zip(self.powers, columns, strict=True):
            total = total + (own.astype(np.uint64) + np.uint64(1)) * power
        return total

    def owners(self, window: int) -> np.ndarray:
        return self.items[self.offsets[window] : self.offsets[window + 1]]


class Phrases:
    """Windows of a block of test items, by size."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.terms = _Numbers()
        self.ids = sorted({str(i) for i, _ in items})
        number = {x: n for n, x in enumerate(self.ids)}
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            own = np.fromiter(map(self.terms.__getitem__, common.words(text)), np.int32)
            if size := min(window, len(own)):
                by_size.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(own, size), number[str(item)]))
        self.groups = [Group(np.concatenate([w for w, _ in x]), np.repeat([n for _, n in x], [len(w) for w, _ in x])) for _, x in sorted(by_size.items())]


def posted(texts: list[list[bytes]]) -> tuple[bytes, bytes, bytes]:
    """Terms (with a space between), the length of each one's list, and the lists, as gaps, of a segment's documents.

    Documents lie one after the other with a place between them that no phrase can bridge.
    """
    terms = _Numbers()
    which = [np.fromiter(map(terms.__getitem__, own), np.int32, len(own)) for own in texts]
    spot = [np.arange(len(w)) for w in which]
    start = 0
    for own in spot:
        own += start
        start += len(own) + 1
    term, spot = np.concatenate(which), np.concatenate(spot)
    order = np.argsort(term.astype(np.uint16) if len(terms) < 1 << 16 else term, kind="stable")
    counts, positions = np.bincount(term, minlength=len(terms)), spot[order]
    gaps = np.diff(positions, prepend=0)
    first = np.cumsum(counts) - counts
    gaps[first] = positions[first]
    return b" ".join(terms), counts.astype("<i4").tobytes(), gaps.astype("<i4").tobytes()


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SEGMENT_WORDS) -> DataFrame:
    """The index of docs: a row for each segment. To be stored; `stored` does so in the scratch folder."""
    common.bounded_batches(docs.sparkSession)
    own = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.xxhash64(own), F.lit(0)).alias("d"), own.alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("index", dict)  # what other operators have this worker remember goes
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, lengths, made, held, n = [0], [], [], [], 0

            def close() -> None:
                made.append(posted(held))
                ends.append(ends[-1] + len(held))

            for words in map(common.words, batch["t"].to_pylist()):
                if held and n + len(words) > limit:
                    close()
                    held, n = [], 0
                held.append(words)
                lengths.append(len(words))
                n += len(words)
            close()
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, x) for x in (batch["k"], batch["d"], pa.array(lengths, pa.int64()))]
            out = [pa.array(range(number, number + len(made)), pa.int64()), *lists, *(pa.array(x, pa.binary()) for x in zip(*made, strict=True))]
            number += len(made)
            yield pa.RecordBatch.from_arrays(out, ["segment", "keys", "digests", "lengths", "terms", "counts", "gaps"])
            common.trim()

    return rows.mapInArrow(make, f"segment long, keys array<{kind}>, digests array<long>, lengths array<long>, terms binary, counts binary, gaps binary")


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SEGMENT_WORDS) -> DataFrame:
    return common.cut(build(docs, key, text, limit), "index")


class Segment:
    """A row of the index, for the terms of a block of items."""

    def __init__(self, lengths: np.ndarray, terms: bytes, counts: bytes, gaps: bytes, wanted: dict[bytes, int]):
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        names = terms.split(b" ") if len(counts) else []
        number = np.fromiter((wanted.get(w, -1) for w in names), np.int64, len(names))
        counts, total = np.frombuffer(counts, "<i4").astype(np.int64), np.cumsum(np.frombuffer(gaps, "<i4"), dtype=np.int64)
        first = np.cumsum(counts) - counts
        self.positions = total - np.repeat(total[first] - np.frombuffer(gaps, "<i4")[first], counts) if len(counts) else total
        here = np.flatnonzero(number >= 0)
        self.count, self.first = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        self.count[number[here]], self.first[number[here]] = counts[here], first[here]
        #: The term at each position, -1 for none that is wanted.
        self.term = np.full(int(self.starts[-1]) + 1, -1, np.int64)
        self.term[self.positions] = np.repeat(number, counts)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term] + self.count[term]]

    def _union(self, terms: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """Different positions in the lists of the terms, each list shifted back."""
        n = self.count[terms]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) - np.repeat(ends - n, n) + np.repeat(self.first[terms], n)
        place = self.positions[at] - np.repeat(shifts, n)
        marked = np.zeros(len(self.term), bool)
        marked[place[place >= 0]] = True
        return np.flatnonzero(marked)

    def phrases(self, group: Group) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of each exact occurrence of a window."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = self.count[group.windows]
        alive = np.flatnonzero(counts.min(axis=1) > 0)
        if not len(alive):
            return none
        rarest = counts[alive].argmin(axis=1)
        pairs = np.unique(group.windows[alive, rarest].astype(np.int64) * group.size + rarest)
        at = self._union(pairs // group.size, pairs % group.size)
        at = at[at + group.size <= len(self.term)]
        for k in range(group.size):  # places at which some wanted term follows at each offset
            at = at[self.term[at + k] >= 0]
        h = group.hashes(self.term[at + k] for k in range(group.size)) if len(at) else np.zeros(0, np.uint64)
        which = np.minimum(np.searchsorted(group.sorted, h), len(group.sorted) - 1)
        same = np.flatnonzero(group.sorted[which] == h) if len(at) else np.zeros(0, np.int64)
        at, which = at[same], which[same]
        for k in range(group.size):
            same = self.term[at + k] == group.windows[which, k]
            at, which = at[same], which[same]
        return at, which

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Start of each place from which all terms follow in order within `span` words, in one document."""
        if not self.count[terms].all():
            return np.zeros(0, np.int64)
        first = self.postings(terms[0])
        at, alive = first, np.ones(len(first), bool)
        for t in terms[1:]:
            own = self.postings(t)
            i = np.searchsorted(own, at, side="right")
            alive &= i < len(own)
            at = np.where(alive, own[np.minimum(i, len(own) - 1)], at)
        return first[alive & (at - first < span) & (self.document(at) == self.document(first))]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _segments(batches: Iterator[pa.RecordBatch], wanted: dict[bytes, int]) -> Iterator[tuple[int, Segment]]:
    """(number, segment) of each row of the index, one at a time, read from Arrow's own memory."""
    common.held("index", dict)
    for batch in batches:
        numbers, lengths = batch["segment"].to_pylist(), batch["lengths"]
        terms, counts, gaps = (batch[c] for c in ("terms", "counts", "gaps"))
        for n in range(batch.num_rows):
            yield numbers[n], Segment(lengths[n].values.to_numpy(), terms[n].as_py(), counts[n].as_buffer(), gaps[n].as_buffer(), wanted)
        common.trim()


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about block_bytes, streamed through the driver one block at a time."""
    held, n = [], 0
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).filter("i is not null and t is not null")
    for row in rows.toLocalIterator():
        held.append((row["i"], row["t"]))
        n += len(row["t"].encode())
        if n >= block_bytes:
            yield held
            held, n = [], 0
    if held:
        yield held


HITS = "segment long, number int, spans array<struct<a:int,b:int>>, items array<string>"
_HITS = pa.schema([("segment", pa.int64()), ("number", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])
#: Columns of the index that questions read.
_ASKED = ("segment", "lengths", "terms", "counts", "gaps")


def hits(index: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, block_bytes: int) -> DataFrame:
    """For each document with an occurring window: its number in its segment, the spans of words hit (apart and in order) and the items."""
    spark, out = index.sparkSession, spark_empty(index, HITS)
    for block in blocks(benchmark, item, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(Phrases(block, window))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            p = sent.value
            for number, s in _segments(batches, p.terms):
                edge, own = np.zeros(len(s.term) + 1, np.int32), {}
                for group in p.groups:
                    at, which = s.phrases(group)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + group.size, -1)
                    for d, w in {*zip(s.document(at).tolist(), which.tolist(), strict=True)}:
                        own.setdefault(d, set()).update(group.owners(w).tolist())
                if not own:
                    continue
                step = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
                a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                d = s.document(a)
                a, b = a - s.starts[d], b - s.starts[d]
                rows = sorted(own)
                spans = [[{"a": x, "b": y} for x, y in zip(a[d == n].tolist(), b[d == n].tolist(), strict=True)] for n in rows]
                found = {"segment": [number] * len(rows), "number": rows, "spans": spans, "items": [[p.ids[i] for i in sorted(own[n])] for n in rows]}
                yield pa.RecordBatch.from_pydict(found, schema=_HITS)

        out = out.unionByName(index.select(*_ASKED).mapInArrow(find, HITS))
    return out


def spark_empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def judged(index: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, share: int, block_bytes: int) -> DataFrame:
    """k, d (a hash of the text) and the results of each document of the index."""
    found = hits(index, benchmark, item, item_text, window, block_bytes)
    both = found.groupBy("segment", "number").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    state = lambda end, n: F.struct(end.cast("int").alias("end"), n.cast("long").alias("n"))
    reached = lambda s, x: state(F.greatest(s["end"], x["b"]), s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"])))
    covered = F.aggregate(F.array_sort("spans"), state(F.lit(0), F.lit(0)), reached, lambda s: s["n"])
    both = both.select("segment", "number", covered.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    docs = index.select("segment", F.posexplode(F.arrays_zip("keys", "digests", "lengths")).alias("number", "x"))
    out = docs.join(both, ["segment", "number"], "left")
    n, h, ids = F.col("x.lengths"), F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("x.keys").alias("k"), F.col("x.digests").alias("d"), n.alias("n_words"), h.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((h > 0) & (share * h >= n)).alias("contaminated"),
    )


def judge(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES, segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words) of each row of docs."""
    out = judged(stored(docs, key, text, segment_words), benchmark, item, item_text, window, share, block_bytes)
    return out.drop("d").withColumnRenamed("k", key)


def matches(
    index: DataFrame, queries: DataFrame, key: str = "doc_id", item: str = "item_id", item_text: str = "text", span: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (key, item, position) of each exact occurrence of a whole query text in a stored index, or, with span, of
    each place from which its words follow in order within that many words. Positions count words from 0."""
    out = spark_empty(index, "segment long, number int, item string, position long")
    for block in blocks(queries, item, item_text, block_bytes):
        sent = index.sparkSession.sparkContext.broadcast(Phrases(block, 1 << 40))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            p = sent.value
            for number, s in _segments(batches, p.terms):
                for group in p.groups:
                    if span is None:
                        at, which = s.phrases(group)
                    else:
                        alive = np.flatnonzero(s.count[group.windows].min(axis=1) > 0).tolist()
                        each = [s.near(group.windows[w], span) for w in alive]
                        at, which = np.concatenate([*each, np.zeros(0, np.int64)]), np.repeat(np.array(alive, np.int64), [len(x) for x in each])
                    times = group.offsets[which + 1] - group.offsets[which]
                    d = s.document(at)
                    if len(at):
                        names = [p.ids[i] for w in which.tolist() for i in group.owners(w).tolist()]
                        own = [pa.array(np.full(len(names), number)), pa.array(np.repeat(d, times).astype(np.int32)), pa.array(names, pa.string()), pa.array(np.repeat(at - s.starts[d], times))]
                        yield pa.RecordBatch.from_arrays(own, ["segment", "number", "item", "position"])

        out = out.unionByName(index.select(*_ASKED).mapInArrow(find, out.schema))
    docs = index.select("segment", F.posexplode("keys").alias("number", "k"))
    return out.join(docs, ["segment", "number"]).select(F.col("k").alias(key), "item", "position")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contamination of every document by any item of the benchmark."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, common.read(spark, sf_dir, "benchmark")).select("doc_id", *[x.split()[0] for x in RESULT.split(", ")])


#: The same in DuckDB SQL.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS phrase, least(len(w), 13) AS size
      FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM p),
o AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
      FROM d, s, unnest(range(1, greatest(len(w) - size + 2, 1))) AS t(i)),
m AS (SELECT DISTINCT o.doc_id, o.i, o.size, p.item_id FROM o JOIN p USING (phrase, size)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + size)) AS t(j) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Documents that are not contaminated; columns stay."""
    found = judged(stored(docs, key, text), benchmark, "item_id", "text", WINDOW, 20, BLOCK_BYTES)
    dirty = common.cut(found.filter("contaminated").select(F.col("k").alias("_k"), F.col("d").alias("_other")).distinct(), "contaminated")
    if dirty.count() * 32 <= broadcast_bytes:
        dirty = F.broadcast(dirty)  # else both sides are shuffled by id and hash
    rows = docs.withColumn("_d", F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)))
    return rows.join(dirty, F.col(f"`{key}`").eqNullSafe(F.col("_k")) & (F.col("_d") == F.col("_other")), "left_anti").drop("_d")
