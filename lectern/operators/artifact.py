"""Prepared books as tables: identifiers, hashes, resumption, integrity, rendering.

Ordered aggregates collect one chapter's units or one book's chapters, which the artifact holds as
one document anyway.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact, native
from ..functions import patterns as P

KEY_FIELDS = ("source_text", "chapter_title", "previous_context", "following_context", "prompt_version", "policy", "validation_policy", "provider")


def identified(units: DataFrame, chapter: str = "chapter_index") -> DataFrame:
    """units with unit_id and source_sha256."""
    return units.withColumns({"unit_id": native.unit_id(F.col(chapter), F.col("position"), F.col("text")), "source_sha256": native.sha256(F.col("text"))})


def cache_key(policy: dict, provider: dict) -> Column:
    """Hash of canonical JSON over all that an answer depends on; one change in any of it is another key."""

    @F.pandas_udf("string")
    def key(text: pd.Series, title: pd.Series, before: pd.Series, after: pd.Series, prompt: pd.Series, rules: pd.Series) -> pd.Series:
        rows = zip(text, title, before, after, prompt, rules, strict=True)
        return pd.Series([exact.canonical_hash(dict(zip(KEY_FIELDS, (*row, policy, provider), strict=True))) for row in rows])

    return key("source_text", "chapter_title", "previous_context", "following_context", "prompt_version", "policy")


def native_key(*columns: str) -> Column:
    """A key without Python: of JSON with the fields in order of name and nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def latest(cache: DataFrame, order: str) -> DataFrame:
    """One row for each key, the last by order."""
    names = [c for c in cache.columns if c != "cache_key"]
    return cache.groupBy("cache_key").agg(F.max_by(F.struct(*names), order).alias("_r")).select("cache_key", "_r.*")


def resumed(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses). The cache has one row for each key."""
    return requests.join(cache, "cache_key"), requests.join(cache.select("cache_key"), "cache_key", "left_anti")


def joined_text(rows: DataFrame, keys: tuple[str, ...], order: str, text: str, name: str = "prepared_text") -> DataFrame:
    """Stripped texts that are not blank, in order, with a blank line between them."""
    own = native.strip(F.coalesce(F.col(text), F.lit("")))
    ordered = F.sort_array(F.collect_list(F.when(own != "", F.struct(F.col(order).alias("o"), own.alias("t")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias(name))


def chapters_of(units: DataFrame, keys: tuple[str, ...] = ("book_id", "chapter_index")) -> DataFrame:
    """A row for each chapter: its prepared text and the hash of that."""
    return joined_text(units, keys, "position", "prepared_text").withColumn("prepared_sha256", native.sha256(F.col("prepared_text")))


def books_of(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """A row for each book: prepared text, and a hash over its chapters' hashes in order."""
    text = native.strip(F.coalesce(F.col("prepared_text"), F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("chapter_index").alias("o"), text.alias("t"), F.col("prepared_sha256").alias("h"))))
    rows = chapters.groupBy(book).agg(ordered.alias("c"))
    own = F.filter(F.transform("c", lambda x: x["t"]), lambda t: t != "")
    digest = F.sha2(F.array_join(F.transform("c", lambda x: x["h"]), "\n"), 256)
    return rows.select(book, F.array_join(own, "\n\n").alias("prepared_text"), digest.alias("book_sha256"))


def _issue(rows: DataFrame, wrong: Column, key: Column, text: str) -> DataFrame:
    return rows.filter(wrong).select(key.cast("string").alias("at"), F.lit(text).alias("issue"))


def unit_violations(units: DataFrame) -> DataFrame:
    """(at, issue) for each broken rule of the units: one scan, the rules as an array that is exploded."""
    structural = F.col("kind") != "prose"
    rules = (
        (~F.col("kind").isin("prose", "heading", "scene_marker", "display_line"), "unknown unit kind"),
        (native.sha256(F.col("source_text")) != F.col("source_sha256"), "stale source hash"),
        (native.sha256(F.col("prepared_text")) != F.col("prepared_sha256"), "stale prepared hash"),
        (structural & (F.col("source_text") != F.col("prepared_text")), "structural text changed"),
    )
    found = F.filter(F.array(*[F.when(wrong, F.lit(text)) for wrong, text in rules]), lambda x: x.isNotNull())
    own = units.select(F.col("unit_id").alias("at"), F.explode(found).alias("issue"))
    twice = units.groupBy("book_id", "unit_id").count().filter("count > 1").select(F.col("unit_id").alias("at"), F.lit("duplicate unit id").alias("issue"))
    place = units.groupBy("book_id", "chapter_index", "position").count().filter("count > 1")
    place = place.select(F.format_string("%s/%d/%d", F.col("book_id").cast("string"), "chapter_index", "position").alias("at"), F.lit("duplicate unit position").alias("issue"))
    return reduce(DataFrame.unionByName, (own, twice, place))


def chapter_violations(chapters: DataFrame, units: DataFrame) -> DataFrame:
    at = F.concat_ws("/", F.col("book_id").cast("string"), F.col("chapter_index").cast("string"))
    truth = chapters_of(units).select("book_id", "chapter_index", F.col("prepared_text").alias("own"))
    rows = chapters.join(truth, ["book_id", "chapter_index"], "left")
    blank = native.strip(F.coalesce(F.col("title"), F.lit(""))) == ""
    return (
        _issue(rows, blank, at, "blank title")
        .unionByName(_issue(rows, F.col("prepared_text") != F.coalesce("own", F.lit("")), at, "chapter text differs from its units"))
        .unionByName(_issue(rows, native.sha256(F.col("prepared_text")) != F.col("prepared_sha256"), at, "stale prepared hash"))
    )


def nested(chapters: DataFrame, units: DataFrame, books: DataFrame) -> DataFrame:
    """A row for each book with its chapters and their units inside, the form of the JSON artifact."""
    u = F.sort_array(F.collect_list(F.struct("position", "unit_id", "kind", "source_text", "prepared_text", "source_sha256", "prepared_sha256", "cache_key", "edits", "warnings")))
    inner = units.groupBy("book_id", "chapter_index").agg(u.alias("units"))
    rows = chapters.join(inner, ["book_id", "chapter_index"], "left")
    c = F.sort_array(F.collect_list(F.struct(F.col("chapter_index").alias("index"), "title", "source_text", "normalized_text", "prepared_text", "prepared_sha256", "units")))
    return books.join(rows.groupBy("book_id").agg(c.alias("chapters")), "book_id").withColumn("schema_version", F.lit(P.SCHEMA_VERSION))


def _section() -> Column:
    """A chapter under its title, unless its text opens with it."""
    first = F.lower(F.regexp_replace(F.substring_index("prepared_text", "\n", 1), F.lit("^#+ *"), F.lit("")))
    return F.when(first == F.lower("title"), F.col("prepared_text")).otherwise(F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("prepared_text")))


def markdown(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, chapter_index, markdown): a row for each chapter that is not blank, and one without chapter_index for title and
    provider. A book's parts in order, nulls first, with a blank line between them and a line end make its markdown;
    no book has to be one string. Each book has at least one chapter."""
    head = books.select("book_id", F.lit(None).cast(chapters.schema["chapter_index"].dataType).alias("chapter_index"), F.format_string("# %s\n\n_Prepared by %s_", "title", "provider").alias("markdown"))
    own = chapters.select("book_id", "chapter_index", native.strip(F.coalesce(_section(), F.lit(""))).alias("markdown")).filter("markdown != ''")
    return head.unionByName(own)


def drift(books: DataFrame, sources: DataFrame) -> DataFrame:
    """(book_id, state): whether the source file is missing, of unknown hash, changed or unchanged."""
    rows = books.select("book_id", "path", "sha256").join(sources.select("path", F.col("sha256").alias("now")), "path", "left")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("sha256") != F.col("now"), "changed").otherwise("unchanged")
    return rows.select("book_id", state.alias("state"))


def flagged(units: DataFrame, most: int | None = None) -> DataFrame:
    """Prose units with warnings or edits, those with warnings first, then by how many of either, then by place."""
    rows = units.filter("kind = 'prose'").withColumns({"n_warnings": F.size("warnings"), "n_edits": F.size("edits")})
    rows = rows.filter("n_warnings > 0 or n_edits > 0").orderBy(F.col("n_warnings") == 0, F.desc("n_warnings"), F.desc("n_edits"), "chapter_index", "position")
    return rows if most is None else rows.limit(most)


def narration_minutes(chapters: DataFrame, keys: tuple[str, ...] = ("book_id",), text: str = "prepared_text") -> DataFrame:
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return chapters.groupBy(*keys).agg(F.sum(words).cast("long").alias("words"), (F.sum(words) / P.WORDS_PER_MINUTE).alias("minutes"))


def model_mix(units: DataFrame, header: DataFrame) -> DataFrame:
    """(book_id, provider, model, units) of prose that the book's own model did not prepare."""
    counts = units.filter("kind = 'prose' and model is not null").groupBy("book_id", "provider", "model").agg(F.count("*").alias("units"))
    return counts.join(header.select("book_id", "provider", "model"), ["book_id", "provider", "model"], "left_anti")
