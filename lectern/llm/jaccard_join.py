"""Similarity join of texts by the Jaccard similarity of their word n-grams.

1. One scan makes, for each text, a digest, K MinHash values and B band keys of R values each.
   Texts with equal digests form one class; the least id stands for it.
2. Representatives that share a band key meet in buckets; those of one member end here. A large
   bucket is dealt in blocks, a task taking a pair of blocks. Within it pairs are compared on
   their MinHash values a few at a time; a pair is dropped as soon as the posterior probability
   that its similarity reaches the threshold falls below a tolerance (uniform prior, so the
   posterior is a Beta distribution). No pair becomes a row: a task reports the edges to the least member
   of each component of what it has left, fewer than it has members.
3. Components of these edges are found by hooking and pointer jumping over DataFrames. Each
   component's members meet once, again by pairs of blocks, with their n-gram sets. The pairs
   of step 2 are pruned the same way and verified exactly; a task reports partial numbers of
   links and the edges to the least member of the verified ones.
4. Components of verified edges are the near-duplicate classes.

n-grams are compared as 64-bit hashes. A text of fewer words than an n-gram has all its words
as its only n-gram; one without words (null, empty) has none, links to nothing, and is a class
with its exact copies only. Rows without an id are left out. Rows sharing an id and a text are
one document; of rows sharing an id with other texts each counts as a copy or link of its own
under that id, and `one_of_each` judges each by its own text. Ties go to the least id. Other columns are ignored.

A pair at the threshold shares no band with probability (1 - t^R)^B: 3e-6 at 0.8, R = 5, B = 32.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROWS, BANDS = 5, 32
HASHES = ROWS * BANDS
#: Members of a bucket or component that one task compares with as many others.
BLOCK = 512
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class _WordHashes(dict):
    """Remembers word hashes; starts anew before it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, n: int) -> np.ndarray:
    """Hashes of the word n-grams of a text, with repeats, in order."""
    own = common.words(text)
    if not own:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(common.held("word hashes", _WordHashes).__getitem__, own), np.uint64, len(own))
    size, m = max(1, len(w) - n + 1), min(n, len(w))
    h = np.full(size, m, np.uint64)
    for k in range(m):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + size]
    return common.mix(h)


def minhash(grams: np.ndarray) -> np.ndarray:
    """K values, 16 bits of each: unequal ones agree once in 65536. The least values of a long text are all small, so
    their bits are mixed before some are taken."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048]
        np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return (common.mix(low) >> np.uint64(48)).astype(np.uint16)


def band_keys(values: np.ndarray) -> np.ndarray:
    """(documents, B) keys, each of a band's number and its R values."""
    v = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), v.shape[:2]).copy()
    for k in range(ROWS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, k]
    return common.mix(h)


@cache
def least_matches(threshold: float, tolerance: float, step: int = 8) -> tuple[tuple[int, int], ...]:
    """(n, least matches among n values) at which P(similarity >= threshold | matches) is `tolerance` or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail at t is the
    probability of at most m successes in n + 1 trials of t.
    """
    out = []
    for n in range(step, HASHES + 1, step):
        below, m = 0.0, -1
        while m < n and below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Positions of the pairs (a[i], b[j]) that no step of the comparison drops."""
    left, same, at = np.arange(len(i)), np.zeros(len(i), np.int32), 0
    for n, least in least_matches(threshold, tolerance):
        if not len(left):
            break
        same += (a[i[left], at:n] == b[j[left], at:n]).sum(axis=1, dtype=np.int32)
        keep = same >= least
        left, same, at = left[keep], same[keep], n
    return left


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (the least node of each node's component) after joining pairs (i, j)."""
    while True:
        p, q = root[i], root[j]
        apart = p != q
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|sets[i] ∩ sets[j]| for the given pairs of sorted sets."""
    out = np.zeros(len(i), np.int64)
    ua, ub = np.unique(i), np.unique(j)
    if len(i) < 256 or len(i) < 0.05 * len(ua) * len(ub):
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = sets[x], sets[y]
            at = np.searchsorted(a, b)
            at[at == len(a)] = 0
            out[k] = np.count_nonzero(a[at] == b)
        return out
    # Many pairs of few sets: a Gram matrix by slices of n-grams, each entry counting common ones.
    grams = np.intersect1d(np.unique(np.concatenate([sets[x] for x in ua])), np.unique(np.concatenate([sets[y] for y in ub])), assume_unique=True)
    total = np.zeros((len(ua), len(ub)), np.float32)
    for at in range(0, len(grams), 8192):
        part = grams[at : at + 8192]
        total += _incidence([sets[x] for x in ua], part) @ _incidence([sets[y] for y in ub], part).T
    return np.rint(total[np.searchsorted(ua, i), np.searchsorted(ub, j)]).astype(np.int64)


def _incidence(sets: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(grams)), np.float32)
    for row, s in zip(out, sets, strict=True):
        own = s[np.searchsorted(s, grams[0]) : np.searchsorted(s, grams[-1], side="right")]
        at = np.searchsorted(grams, own)
        row[at[grams[np.minimum(at, len(grams) - 1)] == own]] = 1
    return out


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components by fewer edges: the neighbours that a node names are tied to the least of them, and only
    the node's tie to that one stays. A node names at most one neighbour for each bucket that it was in."""
    named = edges.groupBy("b").agg(F.collect_set("a").alias("all")).withColumn("low", F.array_min("all"))
    own = named.select(F.col("low").alias("a"), "b")
    rest = named.filter(F.size("all") > 1).select(F.col("low").alias("a"), F.explode("all").alias("b")).filter("a != b")
    return own.unionByName(rest).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, for edges (a, b).

    Each round every node takes the least root among its neighbours and its root's neighbours,
    so depths shrink geometrically; the state of each round is a written table. Nodes with very many
    neighbours and roots with very many members are joined by broadcast.
    """
    edges = _contracted(edges)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.cut(both, "edges")
    hubs = common.hot_keys(both, "b")
    root = common.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    before = root
    for _ in range(rounds):
        near = common.hot_join(both, root.withColumnRenamed("node", "b"), "b", hubs).select(F.col("a").alias("node"), "root")
        low = near.groupBy("node").agg(F.min("root").alias("low")).join(root, "node").select("node", "root", F.least("low", "root").alias("low"))
        # The old root learns of what its members have found, then everyone looks up their root's root.
        told = low.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        known = low.join(told, "node", "left").select("node", "root", F.least("low", F.coalesce("told", "low")).alias("new"))
        known = common.cut(known, "known")
        up = known.select(F.col("node").alias("new"), F.col("new").alias("up"))  # a root is a node
        new = common.hot_join(known, up, "new", common.hot_keys(known, "new"))
        new = common.cut(new.select("node", F.least("new", "up").alias("root"), (F.col("root") != F.least("new", "up")).alias("moved")), "roots")
        common.drop(known, before)
        root, before = new.select("node", "root"), new
        if new.filter("moved").isEmpty():
            common.drop(both)
            return root
    raise RuntimeError("components did not settle")


def _block_pairs(rows: DataFrame, group: str, size: DataFrame) -> DataFrame:
    """rows once for each pair of blocks that theirs belongs to: lo and hi name the pair, mine the own block. size: (group, n)."""
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = common.hot_join(rows, size, group, common.hot_keys(rows, group, size))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("digest"), n).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.select(*rows.columns, "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), -1)


def _pairs(frame: pd.DataFrame, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare: all pairs of each group of two or so at once, then those of each larger group."""
    sizes = np.diff(at)
    two = at[:-1][(sizes == 2)]
    mine, lo, hi = (frame[c].to_numpy() for c in ("mine", "lo", "hi"))
    if len(two):
        cross = (lo[two] == hi[two]) | (mine[two] != mine[two + 1])
        yield two[cross], two[cross] + 1
    for first, size in zip(at[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        if lo[first] == hi[first]:
            i, j = np.triu_indices(size, 1)
            yield first + i, first + j
        else:
            own = mine[first : first + size] == lo[first]
            x, y = first + np.flatnonzero(own), first + np.flatnonzero(~own)
            yield np.repeat(x, len(y)), np.tile(y, len(x))


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= limit:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


class _Members:
    """Components among the digests of a batch. Tasks that see much of the same component mostly report the same edges."""

    def __init__(self, digests: np.ndarray):
        self.names = sorted(set(digests.tolist()))
        number = {d: k for k, d in enumerate(self.names)}
        self.node = np.fromiter((number[d] for d in digests.tolist()), np.int64, len(digests))
        self.root = np.arange(len(self.names))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.root = joined(self.root, self.node[i], self.node[j])

    def edges(self) -> tuple[list[bytes], list[bytes]]:
        """From the least digest of each component to its others."""
        other = np.flatnonzero(self.root != np.arange(len(self.root)))
        return [self.names[k] for k in self.root[other].tolist()], [self.names[k] for k in other.tolist()]


def digest(text: Column) -> Column:
    """128 bits of a text; null differs from the empty text."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), text), F.lit(""))))


def similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-4,
) -> DataFrame:
    """(key, class_id, copy_id, n_links) of each document.

    copy_id is the least id among equal texts, class_id the least among all documents that chains
    of links join to it, n_links the number of other documents with a similarity of threshold or more.
    """
    return judged(docs, key, text, n, threshold, tolerance).select(F.col("k").alias(key), "class_id", "copy_id", "n_links")


def judged(docs: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-4) -> DataFrame:
    """What similar() gives, with k, the digest of the text, and the digest `keep` of the text that stands for the class,
    of the document class_id."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(f"`{key}`").alias("k"), digest(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("t")).filter("k is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = (minhash(g).tobytes() if len(g) else None for g in (shingles(t, n) for t in batch["t"]))
            yield pd.DataFrame({"k": batch["k"], "digest": batch["digest"], "v": list(values)})
            common.trim()

    sketched = common.cut(rows.mapInPandas(sketch, f"k {kind}, digest binary, v binary"), "sketches")
    # Equal texts: a task sends one row for each, and equal sketches need no comparison.
    ids = sketched.groupBy("digest", "k").agg(F.count("*").alias("rows_"))
    classes = common.cut(ids.groupBy("digest").agg(F.min("k").alias("rep"), F.count("*").alias("copies"), F.sum("rows_").alias("n")), "classes")
    first = (sketched["digest"] == classes["digest"]) & (sketched["k"] == classes["rep"])
    reps = sketched.filter("v is not null").join(classes, first, "left_semi").groupBy("digest", "k").agg(F.first("v").alias("v"))
    reps = common.cut(reps, "representatives")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            b = band_keys(_matrix(batch["v"])).view(np.int64)
            yield pd.DataFrame({"digest": np.repeat(batch["digest"].to_numpy(), BANDS), "band": b.reshape(-1)})

    banded = common.cut(reps.select("digest", "v").mapInPandas(keys, "digest binary, band long"), "bands")
    full = common.cut(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    met = _block_pairs(banded, "band", full).join(reps.select("digest", "v"), "digest")

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, at in common.whole_groups(batches, ["band", "lo", "hi"]):
            v, members = _matrix(frame["v"]), _Members(frame["digest"].to_numpy())
            for i, j in _gathered(_pairs(frame, at)):
                ok = surviving(v, v, i, j, threshold, tolerance)
                members.join(i[ok], j[ok])
            a, b = members.edges()
            if a:
                yield pd.DataFrame({"a": a, "b": b})
            common.trim()

    in_buckets = met.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    candidates = common.cut(in_buckets.mapInPandas(prune, "a binary, b binary").distinct(), "candidates")
    common.drop(banded, full)
    grouped = common.cut(components(candidates), "grouped")
    sizes = common.cut(grouped.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    members = grouped.withColumnRenamed("node", "digest").join(classes, "digest").join(reps.select("digest", "v"), "digest")
    members = common.cut(members, "members")
    # The members' n-gram sets are made where the texts are read; other texts are not sent anywhere.
    sent = spark.sparkContext.broadcast(common.presence(members.select(F.xxhash64("rep").alias("h"))))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[common.present(sent.value, batch["h"].to_numpy())]
            if len(batch):
                yield pd.DataFrame({"k": batch["k"], "digest": batch["digest"], "grams": [np.unique(shingles(t, n)).tobytes() for t in batch["t"]]})

    made = rows.withColumn("h", F.xxhash64("k")).mapInPandas(sets, f"k {kind}, digest binary, grams binary")
    made = made.join(members.withColumnRenamed("rep", "k"), ["k", "digest"]).dropDuplicates(["digest"])
    made = common.cut(made.select("root", "digest", "copies", "v", "grams"), "sets")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, at in common.whole_groups(batches, ["root", "lo", "hi"]):
            v, copies = _matrix(frame["v"]), frame["copies"].to_numpy()
            digests = frame["digest"].to_numpy()
            keys, members, links = band_keys(v), _Members(digests), np.zeros(len(frame))
            grams = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
            lengths = np.array([len(g) for g in grams])
            for i, j in _gathered(_pairs(frame, at), 1 << 16):
                met = np.zeros(len(i), bool)
                for k in range(BANDS):
                    met |= keys[i, k] == keys[j, k]
                i, j = i[met], j[met]
                ok = surviving(v, v, i, j, threshold, tolerance)
                i, j = i[ok], j[ok]
                both = overlaps(grams, i, j)
                ok = both >= threshold * (lengths[i] + lengths[j] - both) - 1e-9
                i, j = i[ok], j[ok]
                links += np.bincount(i, copies[j], len(frame)) + np.bincount(j, copies[i], len(frame))
                members.join(i, j)
            some = links > 0
            if not some.any():
                continue
            yield pd.DataFrame({"a": digests[some], "b": None, "links": links[some].astype(np.int64)})
            a, b = members.edges()
            yield pd.DataFrame({"a": a, "b": b, "links": 0})
            common.trim()

    pairs = _block_pairs(made, "root", sizes).repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    verified = common.cut(pairs.mapInPandas(verify, "a binary, b binary, links long"), "verified")
    common.drop(candidates, grouped, sizes, members, made, reps)
    links = verified.filter("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    final = components(verified.filter("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    named = common.cut(final.join(classes.select("digest", "rep"), "digest"), "named")
    least = named.groupBy("root").agg(F.min(F.struct("rep", "digest")).alias("least"))
    named = common.hot_join(named, least, "root", common.hot_keys(named, "root"))
    one = classes.join(links, "digest", "left").join(named.select("digest", "least"), "digest", "left").select(
        "digest", F.col("rep").alias("copy_id"), F.coalesce("least.rep", "rep").alias("class_id"), F.coalesce("least.digest", "digest").alias("keep"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    some = F.when(F.col("words"), F.col("n_links")).otherwise(0).cast("long").alias("n_links")
    own = sketched.select("k", "digest", F.col("v").isNotNull().alias("words"))
    return common.hot_join(own, one, "digest", common.hot_keys(own, "digest", classes)).select("k", "digest", "class_id", "keep", "copy_id", some)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all documents: word 5-grams, similarity 0.8 or more."""
    return similar(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: of those with the least id the one of the least digest, and of rows equal in id and
    text any one. Rows without an id stay. Columns stay."""
    found = common.cut(judged(docs, key, text), "judged")
    stays = (F.col("k") == F.col("class_id")) & (F.col("digest") == F.col("keep"))
    ids = found.select(F.col("k").alias("_k"), F.col("digest").alias("_other"), stays.alias("stays"))
    rows = docs.withColumn("_digest", digest(F.col(f"`{text}`")))
    own = (F.col(f"`{key}`") == F.col("_k")) & (F.col("_digest") == F.col("_other"))
    left = rows.join(ids.filter("not stays").select("_k", "_other").distinct(), own, "left_anti")
    again = common.cut(ids.filter("stays").groupBy("_k", "_other").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    if not again.isEmpty():
        left = left.join(again, own, "left_anti").unionByName(left.join(again, own, "left_semi").dropDuplicates([key, "_digest"]))
    return left.drop("_digest")


#: The same in DuckDB SQL.
OP4_SQL = r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS rep, count(DISTINCT doc_id) AS copies FROM documents WHERE doc_id IS NOT NULL GROUP BY text),
w AS (SELECT rep, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
g AS (SELECT DISTINCT rep, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.rep JOIN n y ON b = y.rep WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a),
k AS (SELECT e.a, sum(t.copies) AS links FROM e JOIN t ON e.b = t.rep GROUP BY e.a)
SELECT d.doc_id, coalesce(c.class_id, t.rep) AS class_id, t.rep AS copy_id,
       CASE WHEN n.n IS NULL THEN 0 ELSE coalesce(k.links, 0) + t.copies - 1 END::BIGINT AS n_links
FROM documents d JOIN t ON d.text IS NOT DISTINCT FROM t.text LEFT JOIN c ON c.a = t.rep LEFT JOIN k ON k.a = t.rep
LEFT JOIN n ON n.rep = t.rep WHERE d.doc_id IS NOT NULL
"""
