"""Removal of multi-line chunks that recur anywhere in a corpus.

A text is cut into lines: runs up to a line break or the mark that ends a clause, so that a passage set
inside a paragraph has lines of its own. A hash rolls over the hashes of each two lines in a row, and a
chunk ends after a line where it is less than at the lines before and after: boundaries depend on four lines
alone and shift with them. Chunks of two lines or more with enough characters take part, and so does
each very long line by itself; their first occurrence, by document id, text and place, stays in its text
and every other one goes. Where kept and removed chunks overlap, in texts that repeat themselves, the
removed one wins.

Three passes read the texts: the first counts chunk hashes (a partial sum in each task, then one
row per hash), the second sends the bytes of only those chunks whose hash recurs and groups them
by these bytes, the third takes the removed chunks out. A hash alone removes nothing. Every occurrence but
the first of its group goes, which takes an anti-join on places, so that no frequent chunk meets in a task.

What chunks leave, as a passage within one line or the edges of a passage, `dedup_runs` finds: every
run of 50 words that occurs earlier goes. A run's least hash of 25 words (winnowing) is the same wherever
the run occurs, so only runs whose least hash recurs are sent, as 128-bit digests of their words' bytes.
Each removed word has an earlier copy that stays.

Null and empty texts stay as they are. Rows without an id pass unchanged and take no part. A document is
an id with a text: rows equal in both are one document and lose the same, and rows of one id with
different texts are documents of their own, of which each loses only what recurs in it (the earlier is that of
the lesser 64-bit hash). Columns named otherwise than key and text never matter and are kept, but for old
removed_chunks and removed_chars, which are replaced. A text is handled whole, at about 40 bytes of memory for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What ends a line, besides a line break; those of more than one byte count like a full stop.
MARKS = ".,;:!?"
WIDE_MARKS = "。、．，；：！？؟،؛।॥"
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\r\v\f")] = 1
_KIND[list(f"\n{MARKS}".encode())] = 2
#: The bytes of wide marks, by the first of them.
_WIDE: dict[int, list[bytes]] = {}
for _mark in WIDE_MARKS:
    _WIDE.setdefault(_mark.encode()[0], []).append(_mark.encode())
#: Lines that the rolling hash spans.
WINDOW = 2

_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)
#: Powers that a worker remembers, and characters of a portion, which about so many bytes have.
REMEMBERED, PORTION = 1 << 19, 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers."""
    held = common.held("powers", dict)
    if len(known := held.get(base, ())) >= n:
        return known[:n]
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= REMEMBERED:
        held[base] = out
    return out[:n]


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, _powers(_POWER, len(values)), out=out[1:])
    return np.cumsum(out, out=out)


def _solid(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of True begin and end."""
    padded = np.zeros(len(solid) + 2, bool)
    padded[1:-1] = solid
    turns = np.flatnonzero(padded[1:] != padded[:-1])
    return turns[::2], turns[1::2]


def _counts(places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the places, which rise, lie from each bound to the next, the last one's to the end."""
    return np.diff(np.searchsorted(places, bounds), append=len(places))


def _marked(raw: bytes) -> np.ndarray:
    """Bytes in which each byte of a wide mark is a full stop."""
    data = np.frombuffer(raw, np.uint8)
    if raw.isascii():
        return data
    data = data.copy()
    for lead, marks in _WIDE.items():
        at = np.flatnonzero(data == lead)
        for m in marks if len(at) else ():
            here = at[at + len(m) <= len(data)]
            for k in range(1, len(m)):
                here = here[data[here + k] == m[k]]
            for k in range(len(m)):
                data[here + k] = ord(".")
    return data


def _spans_hash(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the values first:last whose _sums these are, the same wherever they lie, for each pair."""
    return common.mix((sums[last] - sums[first]) * _powers(_INVERSE, len(sums))[first] + (last - first).astype(np.uint64))


def rolled(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of each line's and its predecessors' hashes, of `window` lines; before a text's first line (at `first`) are zeros."""
    place = np.arange(len(hashes)) - first[np.searchsorted(first, np.arange(len(hashes)), side="right") - 1] if len(hashes) else first
    out = hashes.copy()
    for back in range(1, window):
        out[back:] += np.where(place[back:] >= back, hashes[: len(hashes) - back], 0).astype(np.uint64) * np.uint64(pow(_POWER, back, 1 << 64))
    return common.mix(out)


def boundaries(values: np.ndarray, first: np.ndarray | None = None, longest: int = 64) -> np.ndarray:
    """Ends of the chunks of texts whose lines' values lie one after the other, from `first` on each: after local minima
    inside a text, at a text's end, and at least every `longest` lines."""
    n = len(values)
    first = np.zeros(min(n, 1), np.int64) if first is None else first
    if n == 0:
        return np.zeros(0, np.int64)
    low = np.zeros(n + 1, bool)
    low[2:n] = (values[1:-1] < values[:-2]) & (values[1:-1] <= values[2:])  # the end after line i is i + 1
    low[first + 1] = False
    low[first] = True
    low[[0, n]] = False, True
    ends = np.flatnonzero(low)
    gaps = np.diff(ends, prepend=0)
    far = np.flatnonzero(gaps > longest)
    cuts = [np.arange(ends[k] - gaps[k] + longest, ends[k], longest) for k in far.tolist()]
    return np.unique(np.concatenate([ends, *cuts])) if cuts else ends


class Chunks:
    """The chunks that take part, of many texts: row, number in its text, first byte, last one + 1 (that before
    the next line), and a hash of their bytes. All is computed on the texts' bytes, one text after the other."""

    def __init__(self, texts: list[str], least_chars: int, long_line: int):
        own = [t.encode("utf-8", "replace") for t in texts]
        self.raw = b"\n".join(own)
        data = _marked(self.raw)
        text_at, _ = common.flat(own)
        self.text_at = text_at[:-1] + np.arange(len(own))
        text_end = np.append(self.text_at[1:] - 1, len(data))
        kind = _KIND[data]
        starts, stops = _solid(kind == 0)
        # Solid runs with no mark between them are one line.
        heads = np.zeros(len(starts) + 1, bool)
        heads[np.searchsorted(starts, np.flatnonzero(kind == 2))] = True
        heads[0] = True
        head = np.flatnonzero(heads[: len(starts)])
        begin, end = starts[head], stops[np.append(head[1:], len(starts))[: len(head)] - 1]
        n = len(begin)
        line_row = np.repeat(np.arange(len(own)), _counts(begin, self.text_at))
        first = np.flatnonzero(np.diff(line_row, prepend=-1))
        sums = _sums(data.astype(np.uint64) + np.uint64(1))
        ends = boundaries(rolled(_spans_hash(sums, begin, end), first), first)
        more = np.flatnonzero((data & 0xC0) == 0x80)  # bytes of a character after its first
        from_char, to_char = (x - np.searchsorted(more, x) for x in (begin, end))
        long = np.flatnonzero(to_char - from_char >= long_line)
        spans = np.concatenate([[0], ends[:-1]]) << 32 | ends if len(ends) else ends
        spans = np.unique(np.concatenate([spans, long << 32 | (long + 1)])) if len(long) else spans  # in order of texts and places
        a, b = spans >> 32, spans & 0xFFFFFFFF
        self.row = line_row[a]
        self.number = (np.arange(len(spans)) - np.searchsorted(self.row, self.row)).astype(np.int32)
        size = to_char[b - 1] - from_char[a]
        use = (size >= least_chars) & (b - a > 1) | (size >= long_line)
        a, b, self.row, self.number = a[use], b[use], self.row[use], self.number[use]
        following = np.append(begin, len(data))[b] if n else b
        self.first, self.last = begin[a], np.minimum(following, text_end[self.row])
        self.hash = _spans_hash(sums, self.first, end[b - 1]).view(np.int64)

    def body(self, k: int) -> bytes:
        """The bytes to compare: a chunk with its marks, without the white space around it."""
        return self.raw[self.first[k] : self.last[k]].strip()


def _portions(texts: list[str | None], chars: int = PORTION) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about so many characters, or of one longer text; null texts are empty."""
    first, size = 0, 0
    texts = [t or "" for t in texts]
    for k, t in enumerate(texts):
        if k > first and size + len(t) > chars:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """Bytes without some spans, in order of their starts, that may overlap."""
    at, left = 0, []
    for first, last in spans:
        if first > at:
            left.append(raw[at:first])
        at = max(at, last)
    return b"".join([*left, raw[at:]]).decode("utf-8", "replace")


def _but_first(found: DataFrame) -> DataFrame:
    """(k, d, number) of the places of which an earlier one has equal bytes: each row of found but the first of its group.
    Equal rows of docs give equal places, which may come more than once."""
    first = found.groupBy("h", "body").agg(F.min(F.struct("k", "d", "number")).alias("f")).select("f.*")
    return found.select("k", "d", "number").join(first, ["k", "d", "number"], "left_anti")


def _framed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, t and d (a hash of t), the place of a document, and row, all other columns: their names can clash with none."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (key, text)]) if len(docs.columns) > 2 else F.struct(F.lit(0))
    return docs.select(own.alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("d"))


def _plain(frame: DataFrame, names: list[str], key: str, text: str, added: dict) -> DataFrame:
    """The frame's columns under their own names, and the added ones."""
    one = lambda c: F.col("k" if c == key else "t") if c in (key, text) else F.col(f"row.`{c}`")
    return frame.select(*[one(c).alias(c) for c in names if c not in added], *[v.alias(c) for c, v in added.items()])


def _with_numbers(frame: DataFrame, gone: DataFrame, broadcast_bytes: int) -> DataFrame:
    """frame with the `numbers` of what has to go, null where nothing has."""
    gone = common.cut(gone.groupBy("k", "d").agg(F.collect_set("number").alias("numbers")), "removed")
    size = gone.agg(F.sum(F.size("numbers") * 4 + 40)).first()[0] or 0
    if size <= broadcast_bytes:
        gone = F.broadcast(gone)  # else both sides are shuffled by id and hash
    return frame.join(gone, ["k", "d"], "left")


def recurring_chunks(frame: DataFrame, least_chars: int, long_line: int) -> DataFrame:
    """The bytes of chunks whose hash recurs, with their places: (k, d, number, h, body)."""
    spark = frame.sparkSession
    common.bounded_batches(spark)
    rows = frame.select("k", "d", "t").filter("k is not null and t is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [Chunks(part, least_chars, long_line).hash for _, part in _portions(batch["t"].tolist())]
            if sum(map(len, own)):
                u, n = np.unique(np.concatenate(own), return_counts=True)
                yield pd.DataFrame({"h": u, "n": n})
            common.trim()

    again = rows.select("t").mapInPandas(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    # The exact comparison follows, so false hits of the filter only cost time.
    sent = spark.sparkContext.broadcast(common.presence(again.select("h")))

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k, d = batch["k"].to_numpy(), batch["d"].to_numpy()
            for first, part in _portions(batch["t"].tolist()):
                c = Chunks(part, least_chars, long_line)
                hit = np.flatnonzero(common.present(sent.value, c.hash))
                if len(hit):
                    row = first + c.row[hit]
                    yield pd.DataFrame({"k": k[row], "d": d[row], "number": c.number[hit], "h": c.hash[hit], "body": [c.body(x) for x in hit.tolist()]})
            common.trim()

    return common.cut(rows.mapInPandas(bodies, f"k {kind}, d long, number int, h long, body binary"), "chunks")


def _without_chunks(frame: DataFrame, least_chars: int, long_line: int, broadcast_bytes: int, run: int | None) -> DataFrame:
    """frame with new texts t, and chunks, chars and, if runs follow, the hashes that stand for the new text's runs."""
    found = recurring_chunks(frame, least_chars, long_line)
    joined = _with_numbers(frame, _but_first(found), broadcast_bytes)
    common.drop(found)

    @F.pandas_udf("t string, chunks int, chars long, hashes array<long>")
    def strip(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        new, removed = texts.tolist(), np.zeros(len(texts), np.int32)
        rows = [k for k, own in enumerate(numbers) if own is not None and len(own)]
        for at, part in _portions([new[k] for k in rows]):
            c = Chunks(part, least_chars, long_line)
            gone = np.concatenate([np.asarray(numbers.iloc[k], np.int64) | n << 32 for n, k in enumerate(rows[at : at + len(part)])])
            hit = np.flatnonzero(np.isin(c.row.astype(np.int64) << 32 | c.number, gone))
            for own in np.split(hit, np.flatnonzero(np.diff(c.row[hit])) + 1) if len(hit) else ():
                n = c.row[own[0]]
                base = c.text_at[n]
                new[rows[at + n]] = without(part[n].encode("utf-8", "replace"), list(zip((c.first[own] - base).tolist(), (c.last[own] - base).tolist(), strict=True)))
                removed[rows[at + n]] = len(own)
        chars = [len(t) - len(n) if n is not None else 0 for t, n in zip(texts, new, strict=True)]
        hashes = [h for _, part in _portions(new) for h in Runs(part, run).by_text()] if run else [None] * len(new)
        common.trim()
        return pd.DataFrame({"t": new, "chunks": removed, "chars": np.array(chars, np.int64), "hashes": hashes})

    # Called non-deterministic, or a later filter on its result would run it a second time.
    return joined.withColumn("new", strip.asNondeterministic()("t", "numbers")).select("row", "k", "new.*")


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, long_line: int = 250,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """docs with recurring chunks taken out of their text; `removed_chunks` and `removed_chars` say how much went."""
    done = _without_chunks(_framed(docs, key, text), least_chars, long_line, broadcast_bytes, None)
    return _plain(done, docs.columns, key, text, {"removed_chunks": F.col("chunks"), "removed_chars": F.col("chars")})


#: Words of a run that must not recur.
RUN = 50


def _sliding(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each `width` entries in a row."""
    done = 1
    while done * 2 <= width:
        a, done = op(a[:-done], a[done:]), done * 2
    rest = width - done
    return op(a[: len(a) - rest], a[rest:]) if rest else a


class Runs:
    """Runs of so many words, by the number of their first word, of many texts. Words are those of common.words."""

    def __init__(self, texts: list[str | None], run: int):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.run, self.bytes = run, b" ".join(raw).translate(common._WORD_BYTES)
        data = np.frombuffer(self.bytes, np.uint8)
        self.begin, end = _solid(data != 32)
        self.length = end - self.begin
        start, _ = common.flat(raw)
        each = _counts(self.begin, start[:-1] + np.arange(len(raw)))
        self.row = np.repeat(np.arange(len(raw)), each)
        self.number = np.arange(len(self.row)) - np.repeat(np.cumsum(each) - each, each)
        gram = (run + 1) // 2
        width, n = run - gram + 1, len(self.begin)
        self.inside = self.row[run - 1 :] == self.row[: max(n - run + 1, 0)]
        self.texts, self.least = len(texts), np.zeros(0, np.uint64)
        self.chosen, self.chosen_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if self.inside.any():
            words = _spans_hash(_sums(data.astype(np.uint64)), self.begin, end)
            at = np.arange(n - gram + 1)
            grams = _spans_hash(_sums(words), at, at + gram)
            self.least = _sliding(grams, width, np.minimum)
            pad = np.zeros(width - 1, np.uint64)
            # Each place that is the least of some run, so that a hash counts as often as it lies in the text.
            at = np.flatnonzero(_sliding(np.concatenate([pad, np.where(self.inside, self.least, 0), pad]), width, np.maximum) == grams)
            self.chosen, self.chosen_row = grams[at], self.row[at]

    def by_text(self) -> list[np.ndarray]:
        """Each text's chosen hashes."""
        return np.split(self.chosen.view(np.int64), np.searchsorted(self.chosen_row, np.arange(1, self.texts)))

    def digests(self, at: np.ndarray) -> list[bytes]:
        """Of the words' bytes of the runs that begin at these words."""
        plain = b" ".join(self.bytes.split())
        place = np.concatenate([[0], np.cumsum(self.length + 1)])
        spans = zip(place[at].tolist(), (place[at + self.run] - 1).tolist(), strict=True)
        return [hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in spans]


def without_runs(text: str, numbers: list[int], run: int) -> tuple[str, int]:
    """text without the runs that begin at these words, each up to the next word that stays; and how many spans went."""
    own, raw = Runs([text], run), text.encode("utf-8", "replace")
    begin = np.append(own.begin, len(raw))
    step = np.zeros(len(begin) + 1, np.int64)
    np.add.at(step, numbers, 1)
    np.add.at(step, np.asarray(numbers) + run, -1)
    gone = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
    first, last = begin[np.flatnonzero(gone == 1)], begin[np.flatnonzero(gone == -1)]
    kept = zip([0, *last.tolist()], [*first.tolist(), len(raw)], strict=True)
    return b"".join(raw[a:b] for a, b in kept).decode("utf-8", "replace"), len(first)


def _run_hashes(run: int):
    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        out = pd.Series([h for _, part in _portions(texts.tolist()) for h in Runs(part, run).by_text()], dtype=object)
        common.trim()
        return out

    return hashes


def recurring_runs(frame: DataFrame, run: int) -> DataFrame:
    """The digests of runs whose least hash recurs, with their places, for a frame with the `hashes` of its texts."""
    spark = frame.sparkSession
    rows = frame.select("k", "d", "t", "hashes").filter("k is not null and size(hashes) > 0")
    kind = rows.schema["k"].dataType.simpleString()
    again = rows.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    sent = spark.sparkContext.broadcast(common.presence(again.select("h")))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[common.present(sent.value, np.asarray(h)).any() for h in batch["hashes"]]]
            k, d = batch["k"].to_numpy(), batch["d"].to_numpy()
            for first, part in _portions(batch["t"].tolist()):
                r = Runs(part, run)
                at = np.flatnonzero(r.inside & common.present(sent.value, r.least.view(np.int64))) if len(r.least) else ()
                if len(at):
                    row = first + r.row[at]
                    yield pd.DataFrame({"k": k[row], "d": d[row], "number": r.number[at].astype(np.int32), "h": r.least[at].view(np.int64), "body": r.digests(at)})
            common.trim()

    return common.cut(rows.mapInPandas(digests, f"k {kind}, d long, number int, h long, body binary"), "runs")


def _without_runs(frame: DataFrame, run: int, broadcast_bytes: int) -> DataFrame:
    """frame (with hashes) with new texts t, and chunks and chars by how much went."""
    found = recurring_runs(frame, run)
    joined = _with_numbers(frame, _but_first(found), broadcast_bytes)
    common.drop(found)

    @F.pandas_udf("t string, chunks int, chars long")
    def strip(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        made = [(None, 0) if own is None else without_runs(t, own, run) for t, own in zip(texts, numbers, strict=True)]
        new, removed = ([x[k] for x in made] for k in (0, 1))
        chars = [len(t) - len(n) if n is not None else 0 for t, n in zip(texts, new, strict=True)]
        return pd.DataFrame({"t": new, "chunks": np.array(removed, np.int32), "chars": np.array(chars, np.int64)})

    # Only texts that lose something go to Python.
    some = strip.asNondeterministic()(F.when(F.col("numbers").isNotNull(), F.col("t")), "numbers")
    kept = [c for c in frame.columns if c not in ("t", "d", "hashes")]
    return joined.withColumn("new", some).select(*kept, F.coalesce("new.t", "t").alias("t"), F.col("new.chunks").alias("more_chunks"), F.col("new.chars").alias("more_chars"))


def dedup_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs without the runs of words that occur earlier; `removed_chunks` and `removed_chars` say how much went."""
    common.bounded_batches(docs.sparkSession)
    frame = common.cut(_framed(docs, key, text).withColumn("hashes", _run_hashes(run)("t")), "hashes")
    return _plain(_without_runs(frame, run, broadcast_bytes), docs.columns, key, text, {"removed_chunks": F.col("more_chunks"), "removed_chars": F.col("more_chars")})


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, long_line: int = 250, run: int = RUN, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs without recurring chunks, and then without any run of 50 words that recurs in what is left."""
    lines = common.cut(_without_chunks(_framed(docs, key, text), least_chars, long_line, broadcast_bytes, run), "lines")
    done = _without_runs(lines.withColumn("d", F.xxhash64("t")), run, broadcast_bytes)
    added = {f"removed_{c}": F.col(c) + F.col(f"more_{c}") for c in ("chunks", "chars")}
    return _plain(done, docs.columns, key, text, added)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the chunks and the runs of 50 words that recur in the corpus taken out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", "removed_chunks", "removed_chars")
