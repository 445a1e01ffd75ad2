"""Chapters of paged books from an outline, or from headings, or as one.

Input are tables: pages(book_id, page_no, markdown), outline(book_id, ordinal, level, title, page). What
starts a chapter is found with joins and windows; only the joining of pages is a fold, over the
pages of one chapter.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact, native
from ..functions import patterns as P


def book_format(path: str) -> str:
    """pdf or epub, by suffix."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in P.MEDIA_TYPES:
        raise ValueError(f"unsupported book format {suffix or '(none)'}; supported: {', '.join(sorted(P.MEDIA_TYPES))}")
    return suffix[1:]


def select_bookmarks(outline: DataFrame) -> DataFrame:
    """(book_id, title, page, ordinal, narrated, source): numbered entries, with roman parts as mere boundaries; for
    books without any, the shallowest level, if it has more than one entry, its apparatus not narrated."""
    rows = outline.withColumn("title", native.squeezed(F.col("title"))).filter((F.col("title") != "") & (F.col("page") >= 1))
    rows = rows.withColumns({"numbered": F.col("title").rlike("(?U)" + P.NUMBERED_CHAPTER), "part": F.col("title").rlike("(?U)" + P.PART_BOOKMARK)})
    of_book = rows.groupBy("book_id").agg(F.bool_or("numbered").alias("has"), F.min("level").alias("top"), F.min(F.struct("level")).alias("_"))
    rows = rows.join(of_book.drop("_"), "book_id")
    tops = rows.filter(F.col("level") == F.col("top")).groupBy("book_id").agg(F.count("*").alias("tops"))
    rows = rows.join(tops, "book_id")
    by_number = F.col("has") & (F.col("numbered") | F.col("part"))
    by_level = ~F.col("has") & (F.col("level") == F.col("top")) & (F.col("tops") > 1)
    narrated = F.when(F.col("has"), F.col("numbered")).otherwise(~native.is_skipped_section(F.col("title")))
    return rows.filter(by_number | by_level).select(
        "book_id", "title", "page", "ordinal", narrated.alias("narrated"), F.when(F.col("has"), "bookmarks").otherwise("outline").alias("source")
    )


def preludes(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Standard front sections among the first eight lines of pages before the first chapter; the last page of each counts."""
    first = marks.filter("narrated and source = 'bookmarks'").groupBy("book_id").agg(F.min_by("page", "ordinal").alias("first"))
    early = pages.join(first, "book_id").filter(F.col("page_no") < F.col("first"))
    lines = F.transform(F.slice(F.split("markdown", "\n"), 1, 8), lambda x: F.lower(native.strip(x)))
    hit = F.filter(lines, lambda x: x.isin(*P.PRELUDES))
    rows = early.select("book_id", "page_no", F.get(hit, F.lit(0)).alias("t")).filter("t is not null")
    last = rows.groupBy("book_id", "t").agg(F.max("page_no").alias("page"))
    return last.select("book_id", F.initcap("t").alias("title"), "page", F.lit(None).cast("int").alias("ordinal"), F.lit(True).alias("narrated"), F.lit("bookmarks").alias("source"))


def aligned(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """marks at the nearest page, within three, whose text has the title; a page before wins over one after.

    Seven pages a mark are probed by equality, so the join is on keys and not on a range.
    """
    probes = marks.withColumn("offset", F.explode(F.array(*[F.lit(x) for x in (0, -1, 1, -2, 2, -3, 3)])))
    probes = probes.withColumn("page_no", F.col("page") + F.col("offset"))
    hay = pages.select("book_id", "page_no", native.searchable(F.col("markdown")).alias("hay"))
    hits = probes.join(hay, ["book_id", "page_no"]).filter(F.contains("hay", native.searchable(F.col("title"))))
    best = hits.groupBy("book_id", "title", "page").agg(F.min_by("page_no", F.struct(F.abs("offset"), F.col("offset"))).alias("at"))
    return marks.join(best, ["book_id", "title", "page"], "left").withColumn("page", F.coalesce("at", "page")).drop("at")


def joined_pages(pages: Column) -> Column:
    """Pages in order as one text: one that opens in lower case or with closing punctuation goes on with the sentence."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: join_pages([x["markdown"] for x in r]))

    return run(pages)


def join_pages(pages: list[str | None]) -> str:
    out = ""
    for page in filter(None, ((p or "").strip() for p in pages)):
        opening = page.lstrip("#*_ `\t")[:1]
        if out and opening and (opening.islower() or opening in ",;:)”’"):
            page = re.sub(r"^#+[ \t]*", "", page)
            out = out[:-1] + page if out.endswith("-") else out + " " + page
        else:
            out += "\n\n" * bool(out) + page
    return out


def bounded(marks: DataFrame) -> DataFrame:
    """(book_id, page, next): the pages on which a chapter or a part begins, each with the one after it; null for a book's last."""
    bounds = marks.select("book_id", "page").distinct()
    return bounds.withColumn("next", F.lead("page").over(Window.partitionBy("book_id").orderBy("page")))


def marked_chapters(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, chapter_index, title, source_text) from aligned marks.

    A chapter ends before the next boundary page after its own; chapters that share a page share its text.
    """
    bounds = bounded(marks)
    last = pages.groupBy("book_id").agg(F.max("page_no").alias("last"))
    starts = marks.filter("narrated").select("book_id", "title", "page").distinct()
    spans = starts.join(bounds, ["book_id", "page"]).join(last, "book_id").withColumn("end", F.coalesce(F.col("next") - 1, "last"))
    inside = spans.withColumn("page_no", F.explode(F.sequence("page", F.greatest("page", "end")))).filter("page_no <= end")
    clean = pages.select("book_id", "page_no", native.drop_page_numbers(F.col("markdown")).alias("markdown"))
    text = inside.join(clean, ["book_id", "page_no"]).groupBy("book_id", "title", "page").agg(F.sort_array(F.collect_list(F.struct("page_no", "markdown"))).alias("p"))
    content = native.spoken_title(F.col("title"), native.clean_segment(joined_pages(F.col("p"))))
    rows = text.select("book_id", "title", "page", content.alias("source_text")).filter("source_text != ''")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("page", "title")) - 1
    return rows.select("book_id", place.alias("chapter_index"), "title", "source_text")


def heading_chapters(markdown: str) -> list[tuple[str, str]]:
    """Chapters at the shallowest level of headings, if it has two or more; else the whole text as one."""
    text = exact.drop_page_numbers(markdown)
    heads = [(m.start(), len(m[1]), m[2]) for m in re.finditer(r"(?m)^(#{1,6})[ \t]+(\S.*?)[ \t]*$", text)]
    top = min((level for _, level, _ in heads), default=0)
    starts = [(at, title) for at, level, title in heads if level == top]
    out = []
    for (at, title), (end, _) in zip(starts, [*starts[1:], (len(text), "")], strict=True) if len(starts) > 1 else ():
        for pattern, to in P.CLEANUP[:4]:  # images, links, emphasis, code
            title = re.sub(pattern, to.replace("$1", r"\1"), title)
        title, body = " ".join(title.split()), exact.clean_segment(text[at:end])
        if title and not exact.is_skipped_section(title) and exact.has_narratable_body(body):
            out.append((title, body))
    return out or [("Audiobook", exact.clean_segment(text))]


def paged_chapters(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """(book_id, chapter_index, title, source_text) by the best structure that each book offers."""
    marks = select_bookmarks(outline)
    marks = aligned(marks.unionByName(preludes(pages, marks)), pages)
    found = marked_chapters(marks, pages)
    bare = pages.join(found.select("book_id").distinct(), "book_id", "left_anti")
    whole = bare.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "markdown"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.coalesce(x["markdown"], F.lit(""))), "\n\n")

    @F.pandas_udf("array<struct<title:string,source_text:string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"title": a, "source_text": b} for a, b in heading_chapters(t)])

    rest = whole.select("book_id", F.posexplode(split(text)).alias("chapter_index", "c")).select("book_id", "chapter_index", "c.*")
    return found.unionByName(rest)
