"""What a reviewer reads about a prepared book, as text columns over the review frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..operators import artifact


def unit_label(chapter: Column, position: Column, warnings: Column, edits: Column) -> Column:
    """`ch 3 · unit 7 — 2 warnings, 1 edit`."""
    count = lambda n, one: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n > 1, "s").otherwise("")))
    parts = F.concat_ws(", ", count(F.size(warnings), "warning"), count(F.size(edits), "edit"))
    return F.concat(F.lit("ch "), (chapter + 1).cast("string"), F.lit(" · unit "), (position + 1).cast("string"), F.when(parts != "", F.concat(F.lit(" — "), parts)).otherwise(""))


def unit_text(source: Column, prepared: Column, warnings: Column, edits: Column) -> Column:
    """Markdown: both texts, the edits with their reasons, the warnings."""
    said = F.transform(edits, lambda e: F.concat(F.lit("- "), e["category"], F.lit(": “"), e["original"], F.lit("” → “"), e["replacement"], F.lit("”"), F.when(e["reason"] != "", F.concat(F.lit(" ("), e["reason"], F.lit(")"))).otherwise("")))
    warned = F.transform(warnings, lambda w: F.concat(F.lit("- "), w))
    block = lambda title, body: F.when(body != "", F.concat(F.lit(f"**{title}**\n\n"), body))
    return F.concat_ws("\n\n", block("Source", source), block("Prepared", prepared), block("Edits", F.array_join(said, "\n")), block("Warnings", F.array_join(warned, "\n")))


def flagged(units: DataFrame, most: int | None = None) -> DataFrame:
    """Flagged units in order of urgency, with label and text."""
    rows = artifact.flagged(units, most)
    own = [F.col(c) for c in ("warnings", "edits")]
    return rows.withColumns({"label": unit_label(F.col("chapter_index"), F.col("position"), *own), "review": unit_text(F.col("source_text"), F.col("prepared_text"), *own)})


def summary(books: DataFrame, chapters: DataFrame, units: DataFrame) -> DataFrame:
    """(book_id, summary): one line a book on its size, length when read, edits, warnings and cache hits."""
    prose = units.filter("kind = 'prose'").groupBy("book_id").agg(
        F.count("*").alias("units"), F.sum(F.size("edits")).alias("edits"), F.count_if(F.size("warnings") > 0).alias("warned"), F.count_if("cache_hit").alias("hits")
    )
    length = artifact.narration_minutes(chapters)
    rows = books.select("book_id", "title").join(prose, "book_id", "left").join(length, "book_id", "left").fillna(0)
    return rows.select("book_id", F.format_string("%s: %d prose units, %d words, about %s; %d edits, %d units with warnings, %d from an earlier run", "title", "units", "words", native.minutes(F.col("minutes")), "edits", "warned", "hits").alias("summary"))
