"""The exact functions under SQL names: `register(spark)` makes them available to spark.sql."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import exact

#: name -> (function of a text that is not null, SQL type)
SCALARS: dict[str, tuple[Callable[[str], object], str]] = {
    "normalize_text": (exact.normalize_text, "string"),
    "numbered_view": (exact.numbered_view, "string"),
    "mask_citations": (exact.mask_citations, "string"),
    "word_tokens": (exact.tokens, "array<string>"),
    "fold_text": (exact.fold, "string"),
    "collapse_text": (exact.collapse, "string"),
    "strip_label": (exact.strip_label, "string"),
    "block_kind": (exact.block_kind, "string"),
    "clean_segment": (exact.clean_segment, "string"),
    "is_skipped_section": (exact.is_skipped_section, "boolean"),
}


def _column(f: Callable[[str], object], kind: str):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

    return F.pandas_udf(run, kind)


class SentenceSpans:
    """A row for each sentence: number, offsets, text."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        for n, (a, b) in enumerate(exact.sentence_spans(text or ""), 1):
            yield n, a, b, text[a:b]


class ChangeRegions:
    """A row for each span in which a prepared text differs from its source."""

    def eval(self, source: str, prepared: str) -> Iterator[tuple[int, int, str, str]]:
        from ..operators.score import change_regions

        for r in change_regions(source or "", prepared or ""):
            yield r["source_start"], r["source_end"], r["source_text"], r["output_text"]


class NarrationChunks:
    """A row for each narration chunk."""

    def eval(self, content: str) -> Iterator[tuple[int, str, str, str, str]]:
        from ..operators.chunk import narration_chunks

        for c in narration_chunks(content or ""):
            yield tuple(c.values())


TABLES = {
    "sentence_spans": (SentenceSpans, "number int, start int, end int, sentence string"),
    "change_regions": (ChangeRegions, "source_start int, source_end int, source_text string, output_text string"),
    "narration_chunks": (NarrationChunks, "chunk_index int, text string, boundary_after string, previous_context string, following_context string"),
}


def register(spark: SparkSession) -> None:
    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, _column(f, kind))
    for name, (handler, kind) in TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=kind))
