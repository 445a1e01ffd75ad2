"""A prepared book to a narration plan, and with a speaker to chapter audio and a timeline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches, native
from ..operators import audio, chunk
from .providers import speakers


def narration_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters that have something to read."""
    return chapters.filter(native.strip(F.coalesce(F.col("prepared_text"), F.lit(""))) != "")


def plan(chapters: DataFrame, preview: int | None = None) -> DataFrame:
    """What a dry run shows: the chunks of each chapter."""
    batches.bounded(chapters.sparkSession)
    return chunk.chunk_plan(narration_chapters(chapters), text="prepared_text", preview=preview)


#: Samples of speech that a task holds at once, unless one chunk has more.
SAMPLES = 1 << 21


def _said(speaker: str, options: dict, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[np.ndarray, int]]]]:
    """Chunks with their signals and rates, in portions of about SAMPLES samples; a task makes its speaker once."""
    voice = speakers.create(speaker, **options)
    for batch in frames:
        first, made, n = 0, [], 0
        for k, text in enumerate(batch["text"]):
            signal, rate = voice.speak(text)
            made.append((np.asarray(signal, np.float32), rate))
            n += len(signal)
            if n >= SAMPLES or k + 1 == len(batch):
                yield batch.iloc[first : k + 1], made
                first, made, n = k + 1, [], 0


def spoken(chunks: DataFrame, speaker: str = "tone", **options: object) -> DataFrame:
    """chunks with samples and sample_rate."""
    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in chunks.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, made in _said(speaker, options, frames):
            yield batch.assign(samples=[s for s, _ in made], sample_rate=[r for _, r in made])

    return chunks.mapInPandas(run, f"{kinds}, samples array<float>, sample_rate int")


def measured(chunks: DataFrame, speaker: str = "tone", **options: object) -> DataFrame:
    """chunks with what a manifest says of their speech: n_samples, sample_rate, active_rms and peak. A signal is measured where
    it is made and goes no further, so that no row grows with its length."""
    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in chunks.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, made in _said(speaker, options, frames):
            yield batch.assign(
                n_samples=[len(s) for s, _ in made], sample_rate=[r for _, r in made],
                active_rms=[audio.level(s, r) for s, r in made], peak=[audio.loudest(s) for s, _ in made],
            )

    return chunks.mapInPandas(run, f"{kinds}, n_samples int, sample_rate int, active_rms double, peak double")


def matched(rows: DataFrame, keys: tuple[str, ...] = ("book_id", "chapter_index")) -> DataFrame:
    """Measured segments with the gain that brings each towards its chapter's loudness. Their rows are short, so a window over
    a chapter takes the median beside them, and nothing is spoken a second time for it."""
    return audio.gained(rows.withColumn("target", F.median(audio.voiced()).over(Window.partitionBy(*keys))))


def levelled(segments: DataFrame, rate: int, keys: tuple[str, ...] = ("book_id", "chapter_index")) -> DataFrame:
    """segments at their chapter's loudness, with what was done to each."""
    batches.bounded(segments.sparkSession)
    rows = segments.withColumn("_m", audio.measured("samples", rate)).select("*", "_m.*").drop("_m")
    done = audio.matched(rows.withColumn("_c", F.struct(*keys)), "_c").drop("_c")
    return done.withColumn("samples", audio.scaled("samples", F.col("gain_db")))


def manifest(segments: DataFrame, rate: int) -> DataFrame:
    """A row for each chunk: its text, length, and loudness. Signals are only looked at where no n_samples is given."""
    seconds = (F.col("n_samples") if "n_samples" in segments.columns else F.size("samples")) / rate
    return segments.select(
        "book_id", "chapter_index", "chunk_index", "text", "boundary_after", "char_count", F.round(seconds, 3).alias("duration_seconds"),
        audio.target_met(seconds).alias("duration_target_met"), F.round("active_rms", 6).alias("active_rms_before"),
        F.round("active_rms_after", 6).alias("active_rms_after"), F.round("gain_db", 2).alias("normalization_gain_db"),
    )


def timeline(segments: DataFrame, rate: int) -> DataFrame:
    """Start and end of each chapter, silence after it included."""
    whole = audio.chapter_audio(segments, ("book_id", "chapter_index"), rate)
    ms = F.round(F.size(audio.chapter_silence("samples", rate)) * 1000 / rate).cast("long")
    return audio.timeline(whole.select("book_id", "chapter_index", ms.alias("duration_ms")), "book_id", "chapter_index")
