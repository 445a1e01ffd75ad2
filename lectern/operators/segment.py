"""Chapters into units that a provider can take: headings, scene markers and display lines apart, prose packed."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact, native
from ..functions import patterns as P

UNITS = "array<struct<position:int,kind:string,text:string>>"


def packed(pieces: Iterable[str], glue: str, most: int, enough: int | None = None) -> Iterator[str]:
    """Neighbours joined while the result has at most `most` characters and, with `enough`, fewer than that before."""
    held = None
    for piece in pieces:
        if held is None:
            held = piece
        elif len(held) + len(glue) + len(piece) > most or enough is not None and len(held) >= enough:
            yield held
            held = piece
        else:
            held += glue + piece
    if held is not None:
        yield held


def paragraph_parts(paragraph: str, most: int) -> list[str]:
    """A paragraph, or groups of its sentences if it is too long; a sentence stays whole."""
    spans = exact.sentence_spans(paragraph) if len(paragraph) > most else []
    return list(packed((paragraph[a:b] for a, b in spans), " ", most)) if len(spans) > 1 else [paragraph]


def segment_text(text: str, target: int = P.UNIT_TARGET, most: int = P.UNIT_MAX) -> list[tuple[str, str]]:
    """(kind, text) of the units of a normalized text."""
    check_sizes(target, most)
    out: list[tuple[str, str]] = []
    run: list[str] = []

    def close() -> None:
        parts = (part for p in run for part in paragraph_parts(p, most))
        out.extend(("prose", x) for x in packed(parts, "\n\n", most, target))
        run.clear()

    for block in filter(None, (b.strip() for b in re.split(r"\n\s*\n", text))):
        if (kind := exact.block_kind(block)) == "prose":
            run.append(block)
        else:
            close()
            out.append((kind, block))
    close()
    return out


def check_sizes(target: int, most: int, context: int = 0) -> None:
    if not 0 < target <= most:
        raise ValueError("unit sizes must satisfy 0 < target <= max")
    if context < 0:
        raise ValueError("context cannot be negative")


def units(
    chapters: DataFrame, text: str = "normalized_text", keys: tuple[str, ...] = ("book_id", "chapter_index"),
    target: int = P.UNIT_TARGET, most: int = P.UNIT_MAX, context: int = P.UNIT_CONTEXT,
) -> DataFrame:
    """A row for each unit, with the prose before and after it in its chapter, clipped to whole words."""
    check_sizes(target, most, context)

    @F.pandas_udf(UNITS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"position": n, "kind": k, "text": x} for n, (k, x) in enumerate(segment_text(t or "", target, most))])

    own = [F.col(k) for k in keys]
    rows = chapters.select(*own, F.explode(cut(text)).alias("u")).select(*own, "u.*")
    return with_context(rows, keys, context)


def with_context(rows: DataFrame, keys: tuple[str, ...], context: int) -> DataFrame:
    """Neighbouring prose by windows that leave other kinds out. Each is bounded by a chapter."""
    w = Window.partitionBy(*keys).orderBy("position")
    prose = F.when(F.col("kind") == "prose", F.col("text"))
    before = F.last(prose, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(prose, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    side = lambda c, clip: F.when(F.col("kind") == "prose", F.coalesce(clip(c, context), F.lit(""))).otherwise("")
    return rows.withColumns({"previous_context": side(before, native.clip_tail), "following_context": side(after, native.clip_head)})


def packed_column(pieces: Column, glue: str, most: int, enough: int) -> Column:
    """packed() as a fold over an array column."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, piece: Column) -> Column:
        joined = F.concat(a["open"], F.lit(glue), piece)
        full = (F.char_length(joined) > most) | (F.char_length(a["open"]) >= enough)
        return (
            F.when(a["open"].isNull(), F.struct(a["done"].alias("done"), piece.alias("open")))
            .when(full, F.struct(F.array_append(a["done"], a["open"]).alias("done"), piece.alias("open")))
            .otherwise(F.struct(a["done"].alias("done"), joined.alias("open")))
        )

    return F.aggregate(pieces, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def limited(rows: DataFrame, most: int, order: tuple[str, ...] = ("chapter_index", "position"), book: str = "book_id") -> DataFrame:
    """Rows before the first prose unit past `most` of them in each book; structure before it stays.

    That unit is found among the first most + 1 prose units, which tasks sort out before any shuffle; no
    task holds a book.
    """
    place = F.struct(*order)
    w = Window.partitionBy(book).orderBy(*order)
    prose = rows.filter("kind = 'prose'").select(book, place.alias("_end"), *order)
    ends = prose.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most + 1).filter(F.col("_n") == most + 1)
    return rows.join(ends.select(book, "_end"), book, "left").filter(F.col("_end").isNull() | (place < F.col("_end"))).drop("_end")
