"""Chapters to a prepared book: normalize, cut, look up, propose, apply, check.

    chapters -> units -> requests (with a content key) -> cache join -> provider on what misses -> prepared units

Only prose that no earlier run has prepared reaches the provider. Units of all kinds go through one pass, so nothing
before it is computed twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact, native
from ..functions import patterns as P
from ..operators import artifact, segment
from ..operators.edits import EDIT, Policy, apply_edits, issues
from ..operators.running import total_before
from .providers import preparers

PREPARED = f"prepared_text string, edits array<{EDIT}>, warnings array<string>, issues array<string>, provider string, model string, cache_hit boolean"
CACHED = ("prepared_text", "edits", "warnings", "provider", "model")


def normalized(chapters: DataFrame, text: str = "source_text") -> DataFrame:
    """chapters with normalized_text. Null is empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: exact.normalize_text(t or ""))

    return chapters.withColumn("normalized_text", run(text))


def requests(units: DataFrame, provider: str, policy_name: str = "conservative", policy: Policy | None = None) -> DataFrame:
    """Units with what an answer depends on, and its key, which is null for all but prose."""
    description = preparers.create(provider).description
    rows = units.withColumnRenamed("text", "source_text").withColumn("chapter_title", F.coalesce("title", F.lit("")))
    rows = rows.withColumns({"prompt_version": F.lit(description.prompt_version), "policy": F.lit(policy_name)})
    key = artifact.cache_key(asdict(policy or Policy()), description.as_dict())
    return rows.withColumn("cache_key", F.when(F.col("kind") == "prose", key))


def answered(rows: DataFrame, provider: str, policy: Policy | None = None) -> DataFrame:
    """Requests with their prepared text, in one pass; a task makes its provider once.

    Where rows have the columns CACHED as `cached`, an answer that is there is taken, and judged anew by this run's
    policy: what a stale or spoilt store holds comes out with its issues. All but prose stays as it is.
    """
    policy, d = policy or Policy(), preparers.create(provider).description
    names = [c for c in rows.columns if c != "cached"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    columns = ["prepared_text", "edits", "warnings", "issues", "provider", "model", "cache_hit"]

    def answer(model, kind: str, text: str, cached: dict | None) -> tuple:
        if kind != "prose":
            return text, [], [], [], None, None, False
        if cached is not None:
            own = cached["prepared_text"] or ""
            return own, list(cached["edits"]), list(cached["warnings"]), issues(text, own, policy)[0], cached["provider"], cached["model"], True
        new, done, warnings = apply_edits(text, model.propose(text), policy)
        return new.strip(), [asdict(e) for e in done], warnings, issues(text, new, policy)[0], d.name, d.model, False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = preparers.create(provider)
        for batch in batches:
            stored = batch["cached"] if "cached" in batch else [None] * len(batch)
            made = [answer(model, k, t, c) for k, t, c in zip(batch["kind"], batch["source_text"], stored, strict=True)]
            yield pd.concat([batch[names], pd.DataFrame(made, columns=columns, index=batch.index)], axis=1)

    return rows.mapInPandas(run, f"{kinds}, {PREPARED}")


def prepared_units(
    chapters: DataFrame, provider: str = "rules", cache: DataFrame | None = None, most_prose: int | None = None, policy: Policy | None = None,
    target: int = P.UNIT_TARGET, most: int = P.UNIT_MAX, context: int = P.UNIT_CONTEXT,
) -> DataFrame:
    """chapters (book_id, chapter_index, title, source_text) to units with prepared text.

    cache has one row for each cache_key with the columns CACHED; a hit is taken from there and judged anew.
    """
    units = segment.units(normalized(chapters), keys=("book_id", "chapter_index", "title"), target=target, most=most, context=context)
    if most_prose is not None:
        units = segment.limited(units, most_prose)
    asked = requests(artifact.identified(units), provider, policy=policy)
    if cache is not None:
        asked = asked.join(cache.select("cache_key", F.struct(*CACHED).alias("cached")), "cache_key", "left")
    out = answered(asked, provider, policy)
    columns = ["book_id", "chapter_index", "title", "position", "kind", "unit_id", "source_text", "source_sha256", "cache_key", *CACHED, "issues", "cache_hit"]
    return out.select(*columns).withColumn("prepared_sha256", native.sha256(F.col("prepared_text")))


def first_chapters(chapters: DataFrame, most: int, book: str = "book_id", order: str = "chapter_index") -> DataFrame:
    """The first chapters of each book, which a preview takes. Tasks keep `most` of a book before any shuffle."""
    if most < 1:
        raise ValueError("a preview takes at least one chapter")
    place = F.row_number().over(Window.partitionBy(book).orderBy(order))
    return chapters.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def progress(units: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, chapter_index, position, done, total) of the prose units: how many of a book's are done with each, in order.

    Chapters are counted first, so no task holds a book's units.
    """
    prose = units.filter("kind = 'prose'").select(book, "chapter_index", "position")
    counts = total_before(prose.groupBy(book, "chapter_index").agg(F.count("*").alias("n")), book, "chapter_index", "n", "before")
    totals = prose.groupBy(book).agg(F.count("*").alias("total"))
    within = F.row_number().over(Window.partitionBy(book, "chapter_index").orderBy("position"))
    rows = prose.withColumn("k", within).join(counts.drop("n"), [book, "chapter_index"]).join(totals, book)
    return rows.select(book, "chapter_index", "position", (F.col("k") + F.col("before")).cast("long").alias("done"), "total")


@dataclass(frozen=True)
class Options:
    """What a run is asked for. Bad values are refused before anything is read."""

    preview_chapters: int | None = None
    preview_units: int | None = None
    preview_chunks: int | None = None
    timeout_seconds: float = 120.0

    def __post_init__(self) -> None:
        wrong = [f.name for f in fields(self) if (v := getattr(self, f.name)) is not None and v <= 0]
        if wrong:
            raise ValueError(f"these have to be positive: {', '.join(wrong)}")

    def chapters(self, chapters: DataFrame) -> DataFrame:
        return chapters if self.preview_chapters is None else first_chapters(chapters, self.preview_chapters)

    def prepared(self, chapters: DataFrame, provider: str = "rules", **more) -> DataFrame:
        return prepared_units(self.chapters(chapters), provider, most_prose=self.preview_units, **more)
