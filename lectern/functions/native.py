"""Text functions as column expressions: they stay in the JVM and inside whole-stage code generation.

`\\w`, `\\s` and `\\d` are Unicode here, by the flag (?U). Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _u(pattern: str) -> Column:
    return F.lit("(?U)" + pattern)


def _replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, _u(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return _replace(c, r"^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Words joined by single spaces."""
    return strip(_replace(c, r"\s+", " "))


def clean_segment(c: Column) -> Column:
    """Without images, link targets, emphasis, line-end hyphens, page numbers, figure and citation marks."""
    return strip(reduce(lambda x, rule: _replace(x, *rule), P.CLEANUP, c))


def drop_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(P.PAGE_NUMBER_LINE), F.lit(""))


def drop_licence(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(P.LICENCE_TAIL), F.lit(""))


def is_skipped_section(title: Column) -> Column:
    """Whether a title names apparatus, which is not narrated."""
    folded = F.trim(F.regexp_replace(F.replace(F.lower(title), F.lit("’"), F.lit("'")), F.lit("[^a-z' ]+"), F.lit("")))
    return title.rlike(P.LICENCE_SECTION) | folded.isin(*P.SKIPPED_SECTIONS)


def has_narratable_body(c: Column) -> Column:
    """Whether any line is neither blank nor a heading."""
    return F.exists(F.split(c, "\n"), lambda line: (strip(line) != "") & ~strip(line).startswith("#"))


def _whole(c: Column, pattern: str) -> Column:
    return strip(c).rlike("(?U)^(?:" + pattern + ")$")


def is_heading(c: Column) -> Column:
    return _whole(c, P.HEADING) & ~F.contains(strip(c), F.lit("\n"))


def is_scene_marker(c: Column) -> Column:
    return _whole(c, P.SCENE_MARKER)


def is_display_line(c: Column) -> Column:
    """A short block that does not end as a sentence does: a byline, an imprint, a signature."""
    s = strip(c)
    return (s != "") & (F.char_length(s) <= P.DISPLAY_LINE_CHARS) & ~F.contains(F.lit(P.PROSE_ENDINGS), F.right(s, F.lit(1)))


def block_kind(c: Column) -> Column:
    return (
        F.when(is_heading(c), "heading").when(is_scene_marker(c), "scene_marker").when(is_display_line(c), "display_line").otherwise("prose")
    )


def normalize_paragraph(c: Column) -> Column:
    """One line of prose. The input has composed characters (NFC) already; exact.normalize_paragraph composes them."""
    c = F.replace(c, F.lit("\u00ad"), F.lit(""))
    c = F.regexp_replace(c, F.lit(r"(?<=\p{L})-[ \t]*\n[ \t]*(?=[a-z])"), F.lit(""))
    c = F.translate(c, "\u00a0\u2007\u202f", "   ")
    c = F.regexp_replace(c, F.lit(r"(?<=[\p{L}\p{N}_])-[ \t]+(?=[\p{L}\p{N}_])"), F.lit("-"))
    return strip(F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(r"[ \t\f\x0B]+"), F.lit(" ")))


def normalize_text(c: Column) -> Column:
    """Blocks with a blank line between them: headings and scene markers alone, wrapped lines joined.

    A fold over the lines: each prose line joins the open paragraph, which is the last array entry, unless a blank
    line or a marker line closed it.
    """
    c = F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\u00ad"), F.lit(""))
    lines = F.transform(F.split(c, "\n"), strip)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    closed = lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"]))

    def step(a: Column, line: Column) -> Column:
        alone = is_heading(line) | is_scene_marker(line)
        kept = F.when(is_heading(line), F.regexp_replace(line, F.lit(r"[ \t\f\x0B]+"), F.lit(" "))).otherwise(line)
        return (
            F.when(line == "", F.struct(closed(a).alias("done"), F.lit("").alias("open")))
            .when(alone, F.struct(F.array_append(closed(a), kept).alias("done"), F.lit("").alias("open")))
            .otherwise(F.struct(a["done"], F.when(a["open"] == "", line).otherwise(F.concat(a["open"], F.lit("\n"), line)).alias("open")))
        )

    blocks = F.aggregate(lines, start, step, closed)
    # Markers have no line break, so normalizing them as prose would only touch hyphens: they are told apart.
    out = F.transform(blocks, lambda b: F.when(is_heading(b) | is_scene_marker(b), b).otherwise(normalize_paragraph(b)))
    return F.array_join(F.filter(out, lambda b: b != ""), "\n\n")


def fold(c: Column) -> Column:
    """Typographic quotes, dashes and spaces as their plain forms, one for one."""
    return F.translate(c, P.FOLD_FROM, P.FOLD_TO)


def collapse(c: Column) -> Column:
    return squeezed(fold(c))


def strip_label(c: Column) -> Column:
    """Without a leading sentence label; null if nothing else is there."""
    bare = _replace(c, P.LABEL, "")
    return F.when(bare == c, c).when(strip(bare) != "", bare)


def mask_citations(c: Column) -> Column:
    """Numeric references and parentheses with a year and an author or a list, each as one space."""
    c = F.regexp_replace(c, F.lit(P.NUMERIC_REFERENCE), F.lit(" "))
    year = r"(?=[^()]*(?i:\b(?:1[5-9]|20)\d{2}[a-z]?\b))"
    rest = r"(?=[^()]*(?:[,;]|(?i:\bet\s+al\.?\b|\b[a-z][a-z'’.-]+)))"
    return F.regexp_replace(c, F.lit(r"(?U)\(" + year + rest + r"[^()]*\)"), F.lit(" "))


def tokens(c: Column) -> Column:
    """Words outside citations, lower-cased. exact.tokens also folds case and compatibility forms."""
    return F.regexp_extract_all(F.lower(mask_citations(c)), F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?)"), F.lit(1))


def bag_difference(a: Column, b: Column) -> Column:
    """Size of the symmetric multiset difference of two arrays of words: one fold over both, sorted together, in which an
    element of one array adds one to its run's balance and an element of the other takes one off."""
    side = lambda xs, n: F.transform(xs, lambda x: F.struct(x.alias("word"), F.lit(n).alias("by")))
    both = F.array_sort(F.concat(side(a, 1), side(b, -1)))
    state = lambda word, balance, total: F.struct(word.cast("string").alias("word"), balance.cast("int").alias("balance"), total.cast("long").alias("total"))

    def step(s: Column, x: Column) -> Column:
        same = s["word"].eqNullSafe(x["word"])
        return state(x["word"], F.when(same, s["balance"]).otherwise(0) + x["by"], s["total"] + F.when(same, 0).otherwise(F.abs(s["balance"])))

    return F.aggregate(both, state(F.lit(None), F.lit(0), F.lit(0)), step, lambda s: s["total"] + F.abs(s["balance"]))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words."""
    return ((F.size(a) + F.size(b) - bag_difference(a, b)) / 2).cast("long")


def is_summary_lead(c: Column) -> Column:
    return c.rlike(P.SUMMARY_LEAD)


def chunk_paragraph(c: Column) -> Column:
    """A block as narration reads it: heading marks gone, white space single."""
    s = strip(c)
    return squeezed(F.when(s.startswith("#"), F.regexp_replace(s, F.lit("^[# ]+"), F.lit(""))).otherwise(s))


def is_dialogue(c: Column) -> Column:
    return c.rlike("(?U)" + P.DIALOGUE)


def sentence_split(c: Column) -> Column:
    """Sentences; quotes that close one belong to the break and are lost."""
    return F.filter(F.transform(F.split(c, "(?U)" + P.SENTENCE_BREAK), strip), lambda s: s != "")


def clip_tail(c: Column, limit: int) -> Column:
    """At most `limit` last characters, from a word's start where there is a space."""
    tail = F.right(c, F.lit(limit))
    return F.when(F.char_length(c) <= limit, c).when(F.instr(tail, " ") > 0, F.regexp_replace(tail, F.lit(r"(?s)^[^ ]* "), F.lit(""))).otherwise(tail)


def clip_head(c: Column, limit: int) -> Column:
    """At most `limit` first characters, to a word's end where there is a space."""
    head = F.left(c, F.lit(limit))
    return F.when(F.char_length(c) <= limit, c).when(F.instr(head, " ") > 0, F.regexp_replace(head, F.lit(r"(?s) [^ ]*$"), F.lit(""))).otherwise(head)


def searchable(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), F.lit(r"[^\p{L}\p{N}]"), F.lit(""))


def spoken_title(title: Column, content: Column) -> Column:
    """content, with a heading mark if it opens with its chapter's title."""
    bare = strip(_replace(title, r"^\d+\s+", ""))
    return F.when(F.lower(content).startswith(F.lower(bare)) & ~content.startswith("#"), F.concat(F.lit("# "), content)).otherwise(content)


def heading_title(c: Column) -> Column:
    """The first line that is not blank, if it is a heading with words."""
    first = F.regexp_extract(c, r"(?U)^\s*(\S[^\n]*)", 1)
    title = strip(F.regexp_replace(first, F.lit("^#+"), F.lit("")))
    return F.when(first.startswith("#") & (title != ""), title)


def excerpt(c: Column, limit: int = 60) -> Column:
    flat = squeezed(c)
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…")))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def unit_id(chapter: Column, position: Column, text: Column) -> Column:
    return F.format_string("chapter-%04d-unit-%04d-%s", chapter, position, F.left(sha256(text), F.lit(12)))


def escape_metadata(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, F.lit(r"([\\=;#])"), F.lit(r"\\$1")), F.lit("\n"), F.lit(" "))


def percent(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.format_string("%.1f%%", c * 100))


def escape_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def minutes(c: Column) -> Column:
    """`2 h 05 min` or `7 min`."""
    m = F.round(c).cast("int")
    return F.when(m >= 60, F.format_string("%d h %02d min", F.floor(m / 60).cast("int"), m % 60)).otherwise(F.format_string("%d min", m))


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in P.MEDIA_TYPES.items() for x in pair]), suffix)


def book_title(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1), F.lit(r"(?i)\b(?:pdf|epub)\b"), F.lit(""))
    title = F.initcap(squeezed(F.translate(stem, "_-", "  ")))
    return F.when(title == "", "Audiobook").otherwise(title)


def loudness_measurements(log: Column) -> Column:
    """The last flat JSON object of an analysis log as doubles; null if there is none or a value is missing."""
    body = F.regexp_extract(log, r"(?s).*(\{[^{}]*\})", 1)
    keys = ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset")
    own = F.from_json(body, ", ".join(f"{k} string" for k in keys))
    values = [own[k].try_cast("double").alias(k) for k in keys]
    complete = reduce(lambda a, b: a & b, [own[k].try_cast("double").isNotNull() for k in keys])
    return F.when(complete, F.struct(*values))
