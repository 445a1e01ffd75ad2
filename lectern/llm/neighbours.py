"""Approximate nearest neighbours by score-aware quantisation, for largest cosine.

Vectors are scaled to length one and cut into pairs of dimensions, each coded in four bits. Code
books and codes minimise an anisotropic loss: the part of a vector's whole residual along the vector, which shifts
large inner products, weighs more than the part across it. A query meets the codes through tables of
its inner products with all 16 centres of each pair; sums over these tables rank the candidates,
and exact double-precision cosines of the best replace them.

Rows are dealt by a hash of their id into segments of bounded size, queries into blocks of
bounded size, and each pair of block and segment is one unit of work that reports at most k rows
a query: no list of candidates is sent. Within it the best codes are scored exactly; then every
row whose table sum, given both parts of its residual, still admits the k-th best score is scored too: a small
part along the vector makes this bound tight for near rows. Groups of near copies, whose codes agree, are thus told apart
exactly and no limit on candidates can hide a neighbour.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id; vectors of unequal length never meet. Rows equal in id and vector count once; of
rows that share an id with other vectors each is a candidate, though none for a query of that id,
and their queries share one answer. Ties go to the smaller id. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEGMENT_ROWS, BLOCK_QUERIES = 8192, 1024
#: Small tables make smaller segments, so that there is work for this many tasks; large ones use at most MOST_TASKS.
LEAST_SEGMENTS, MOST_TASKS = 12, 20_000
#: Vectors that the code books are fitted on, at most about.
SAMPLE = 20_000
#: Weight of the residual's part along the vector against the part across it.
PARALLEL = 4.0
FIRST = 64


def valid(vector: str):
    """Non-null, of finite non-null components, not all zero."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def residuals(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return x - books[np.arange(len(books)), codes].reshape(len(x), -1)


def _assigned(x: np.ndarray, books: np.ndarray, parallel: float, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
    """Codes that lower the loss of whole vectors, by coordinate descent: the pairs take turns, each choosing the centre
    that is best given the part along the vector that the other pairs' residuals leave."""
    v = x.reshape(len(x), -1, 2)
    if codes is None:
        codes = np.stack([((v[:, p, None] - c) ** 2).sum(axis=2).argmin(axis=1) for p, c in enumerate(books)], axis=1)
    codes = codes.copy()
    along = (residuals(x, codes, books).reshape(v.shape) * v).sum(axis=2)
    total, rows = along.sum(axis=1), np.arange(len(x))
    for _ in range(sweeps):
        for p, c in enumerate(books):
            r = v[:, p, None] - c
            own = (r * v[:, p, None]).sum(axis=2)
            others = total - along[:, p]
            codes[:, p] = ((r**2).sum(axis=2) + (parallel - 1) * (others[:, None] + own) ** 2).argmin(axis=1)
            along[:, p] = own[rows, codes[:, p]]
            total = others + along[:, p]
    return codes


def fit_books(sample: np.ndarray, rounds: int = 8, seed: int = 1, parallel: float = PARALLEL) -> np.ndarray:
    """(pairs, 16, 2) centres. Vectors are unit rows; an odd last dimension is paired with zeros.

    The loss of a vector x with residual r is |r|^2 + (w - 1) (r . x)^2, over all its pairs at once: residuals of
    several pairs along x may cancel. Codes are assigned by coordinate descent, then each centre in turn solves
    its 2 x 2 normal equations, given the other pairs' residuals.
    """
    x = _even(sample)
    r = np.random.default_rng(seed)
    v = x.reshape(len(x), -1, 2)
    books = np.stack([v[r.choice(len(v), 16, replace=len(v) < 16), p] for p in range(v.shape[1])])
    codes = None
    for _ in range(rounds):
        codes = _assigned(x, books, parallel, codes)
        along = (residuals(x, codes, books).reshape(v.shape) * v).sum(axis=2)
        total = along.sum(axis=1)
        for p in range(len(books)):
            u, others = v[:, p], total - along[:, p]
            for k in range(16):
                own = codes[:, p] == k
                if own.any():
                    m = np.count_nonzero(own) * np.eye(2) + (parallel - 1) * u[own].T @ u[own]
                    pull = others[own] + (u[own] ** 2).sum(axis=1)
                    books[p, k] = np.linalg.solve(m, (u[own] * (1 + (parallel - 1) * pull[:, None])).sum(axis=0))
            along[:, p] = ((u - books[p, codes[:, p]]) * u).sum(axis=1)
            total = others + along[:, p]
    return books


def loss(x: np.ndarray, codes: np.ndarray, books: np.ndarray, parallel: float = PARALLEL) -> np.ndarray:
    r = residuals(x, codes, books)
    return (r**2).sum(axis=1) + (parallel - 1) * (r * x).sum(axis=1) ** 2


def encode(unit: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, pairs) below 16, and of each residual the part along its vector and the length of the part across."""
    x = _even(unit)
    codes = _assigned(x, books, PARALLEL)
    r = residuals(x, codes, books)
    along = (r * x).sum(axis=1)
    return codes.astype(np.uint8), np.stack([along, np.sqrt(np.maximum(0, (r**2).sum(axis=1) - along**2))])


def least_sums(score: float, parts: np.ndarray) -> np.ndarray:
    """The table sum below which no row reaches a score.

    With x the row's unit vector, q the query's, s their product and r = a x + b y the row's residual (y across x),
    q . r is at most a s + b sqrt(1 - s^2), so the sum s - q . r is at least (1 - a) s - b sqrt(1 - s^2), which rises
    with s from 0 on. For lower scores the whole length of the residual bounds q . r.
    """
    along, across = parts
    if score < 0:
        return score - np.hypot(along, across)
    return score * (1 - along) - across * np.sqrt(max(0.0, 1 - score * score))


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return even[:, ::2] | even[:, 1::2] << 4


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, rows) table sums; codes are packed. A byte's two tables are joined into one of 256 sums."""
    q = _even(queries).reshape(len(queries), -1, 2)
    tables = np.einsum("qpd,pkd->qpk", q, books).astype(np.float32)
    if tables.shape[1] % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], axis=1)
    joined = tables[:, 1::2, :, None] + tables[:, ::2, None, :]  # high nibble is the second of a byte
    joined = joined.reshape(len(queries), codes.shape[1], 256)
    out = np.zeros((len(queries), len(codes)), np.float32)
    for b in range(codes.shape[1]):
        out += joined[:, b, codes[:, b]]
    return out


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of one query with many rows, in double precision, summed in the order of the components: equal rows give equal results."""
    total = lambda x: np.add.accumulate(x, axis=-1)[..., -1]
    return np.clip(total(vectors * query) / np.sqrt(total(query * query) * total(vectors * vectors)), -1.0, 1.0)


def best(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray,
    parts: np.ndarray, books: np.ndarray, k: int,
) -> tuple[pd.DataFrame, int]:
    """The k rows of a segment nearest to each query of a block, and how many rows beyond the first were scored."""
    out, units, extra = [], _units(vectors), 0
    for at in range(0, len(queries), 64):
        block = queries[at : at + 64]
        own_units = _units(block)
        sums = scan(own_units, codes, books)
        for q, own, unit, sum_ in zip(query_ids[at : at + 64].tolist(), block, own_units, sums, strict=True):
            other = ids != q
            first = np.argpartition(-sum_, min(FIRST, len(ids) - 1))[:FIRST]
            first = first[other[first]]
            score = cosines(own, vectors[first])
            least = np.partition(score, -k)[-k] if len(score) >= k else -np.inf
            may = other & (sum_ >= least_sums(least, parts) - 1e-5) if len(score) >= k else other.copy()
            may[first] = False
            more = np.flatnonzero(may)
            extra += len(more)
            more = more[units[more] @ unit >= least - 1e-9]  # only these can matter in the order of exact sums
            first = np.concatenate([first, more])
            score = np.concatenate([score, cosines(own, vectors[more])])
            order = np.lexsort((ids[first], -score))[:k]
            out.append((np.full(len(order), q), ids[first[order]], score[order]))
    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": c}), extra


def nearest(
    vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5,
    segment_rows: int = SEGMENT_ROWS, block_queries: int = BLOCK_QUERIES, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row for which is_query holds.

    is_query is a condition on the column `id`.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.filter("id is not null").filter(valid("v")).withColumn("d", F.size("v"))
    rows = common.cut(rows, "vectors")
    counted = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()  # a row for each dimension
    sizes = {r["d"]: r["n"] for r in counted}
    books = {}
    for d, n in sizes.items():
        part = common.sampled(rows.filter(F.col("d") == d), F.col("id"), n, sample, 9)
        x = np.array([np.array(r) for r in part.select("v").toPandas()["v"]], float).reshape(-1, d)
        books[d] = fit_books(_units(x if len(x) else np.eye(1, d)))
    sent = spark.sparkContext.broadcast(books)
    rows_of = lambda n: min(segment_rows, max(1, n // LEAST_SEGMENTS))
    counts = [(r["d"], -(-r["n"] // rows_of(r["n"])), max(1, -(-r["q"] // block_queries))) for r in counted]
    dealt = spark.createDataFrame(counts, "d int, segments int, blocks int")
    rows = rows.join(F.broadcast(dealt), "d")  # one row for each dimension
    hashed = F.xxhash64("id", F.lit(1))
    parts = rows.select("d", F.pmod(hashed, "segments").cast("int").alias("segment"), "id", "v")

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        d, segment = int(frame["d"].iloc[0]), int(frame["segment"].iloc[0])
        x = np.stack(frame["v"].to_numpy()).astype(np.float64)
        codes, parts = encode(_units(x), sent.value[d])
        return pd.DataFrame({
            "d": [d], "segment": [segment], "ids": [frame["id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()],
            "codes": [packed(codes).tobytes()], "parts": [parts.tobytes()],
        })

    stored = "d int, segment int, ids binary, vectors binary, codes binary, parts binary"
    segments = common.cut(parts.groupBy("d", "segment").applyInPandas(index, stored), "segments")

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"d": [int(frame["d"].iloc[0])], "query_ids": [frame["id"].to_numpy(np.int64).tobytes()], "queries": [x.tobytes()]})

    asked = rows.filter(is_query).dropDuplicates(["id", "v"])
    asked = asked.select("d", "segments", F.pmod(F.xxhash64("id", F.lit(2)), "blocks").cast("int").alias("block"), "id", "v")
    blocks = common.cut(asked.groupBy("d", "block").applyInPandas(block, "d int, query_ids binary, queries binary"), "blocks")
    every = blocks.join(F.broadcast(dealt.select("d", "segments")), "d")
    every = every.withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1))).drop("segments")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                d = r.d
                yield best(
                    np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.queries, np.float64).reshape(-1, d),
                    np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors, np.float64).reshape(-1, d),
                    np.frombuffer(r.codes, np.uint8).reshape(-1, (d + 3) // 4), np.frombuffer(r.parts, np.float64).reshape(2, -1),
                    sent.value[d], k,
                )[0]

    # A segment meets all blocks in one task, so neither side is sent again after the join.
    tasks = max(1, min(MOST_TASKS, sum(c[1] for c in counts)))
    pairs = every.repartition(tasks, "d", "segment").join(segments.repartition(tasks, "d", "segment"), ["d", "segment"])
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every row whose vec_id is divisible by 50."""
    return nearest(common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


#: The same in DuckDB SQL: all pairs.
OP9_SQL = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
