"""The catalogue of narrators: voice folders, loose recordings, built-in speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: suffixes of recordings.
AUDIO = ("wav", "mp3", "flac", "m4a", "ogg", "opus", "aac")
FIELDS = ("spec", "label", "kind", "audio_path", "transcript_path", "ref_text", "instruct", "folder", "ordinal")


def _label(name: Column, kind: Column) -> Column:
    return F.concat(name, F.lit("  ("), kind, F.lit(")"))


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Files at the root and in its folders, with the text of small ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_extract("path", r"([^/]+)/([^/]+)$", 1)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    text = F.when(F.lower("path").rlike(r"\.(json|txt)$"), F.decode("content", "UTF-8"))
    base = root.rstrip("/").rpartition("/")[2]
    return files.select("path", name.alias("name"), at.alias("dir"), text.alias("body")).withColumn("loose", F.col("dir") == base)


def reference_voices(spark: SparkSession, root: str) -> DataFrame:
    """Voice folders (metadata and audio; malformed metadata is skipped), then loose recordings."""
    files = _listing(spark, root)
    sound = F.lower("name").rlike(rf"\.({'|'.join(AUDIO)})$")
    meta = files.filter(~F.col("loose") & (F.col("name") == "reference.json")).withColumn("m", F.from_json("body", "ref_text string, instruct string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    meta = meta.filter("m is not null and m._bad is null").select("dir", F.col("path").alias("transcript_path"), "m.ref_text", F.expr("nullif(m.instruct, '')").alias("instruct"))
    clips = files.filter(~F.col("loose") & sound).groupBy("dir").agg(F.min("path").alias("audio_path"))
    kind = F.when(F.col("instruct").isNotNull(), "designed").otherwise("recording")
    folders = meta.join(clips, "dir").select(
        F.col("dir").alias("spec"), _label(F.col("dir"), kind).alias("label"), kind.alias("kind"), "audio_path", "transcript_path",
        F.expr("nullif(ref_text, '')").alias("ref_text"), "instruct", F.lit(True).alias("folder"), F.lit(0).alias("ordinal"),
    )
    stem = F.regexp_extract("path", r"(.*)\.[^./]+$", 1)
    texts = files.filter(F.col("loose") & F.lower("name").endswith(".txt")).select(stem.alias("stem"), F.trim("body").alias("ref_text"))
    loose = files.filter(F.col("loose") & sound).withColumn("stem", stem).join(texts, "stem", "left")
    loose = loose.select(
        F.col("path").alias("spec"), _label(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.lit("recording")).alias("label"), F.lit("recording").alias("kind"),
        F.col("path").alias("audio_path"), F.concat("stem", F.lit(".txt")).alias("transcript_path"), F.expr("nullif(ref_text, '')").alias("ref_text"),
        F.lit(None).cast("string").alias("instruct"), F.lit(False).alias("folder"), F.lit(1).alias("ordinal"),
    )
    return folders.unionByName(loose)


def catalogue(voices: DataFrame, roster: DataFrame) -> DataFrame:
    """voices and the built-in speakers (name) that none of them shadows, whatever their case."""
    names = [c for c in FIELDS if c in voices.columns]
    taken = voices.select(F.lower("spec").alias("key")).distinct()
    free = roster.withColumn("key", F.lower("name")).join(taken, "key", "left_anti")
    own = {"spec": F.col("name"), "label": _label(F.col("name"), F.lit("built-in")), "kind": F.lit("built-in"), "folder": F.lit(False), "ordinal": F.lit(2)}
    return voices.select(*names).unionByName(free.select(*[own.get(c, F.lit(None)).cast(voices.schema[c].dataType).alias(c) for c in names]))


def roster_of(config: Column) -> Column:
    """Sorted speaker names of a checkpoint's configuration."""
    return F.sort_array(F.map_keys(F.from_json(config, "talker_config struct<spk_id:map<string,int>>")["talker_config"]["spk_id"]))


def resolved(wanted: DataFrame, voices: DataFrame) -> DataFrame:
    """wanted (spec, ref_text) with the voice each one names: a folder before a path before a file name.

    Its transcript is the one given, or else the voice's own.
    """
    file = F.regexp_extract("audio_path", r"([^/]+)$", 1)
    keys = F.array(F.struct(F.when(F.col("folder"), 0).otherwise(1).alias("p"), F.col("spec").alias("key")), F.struct(F.lit(2).alias("p"), file.alias("key")))
    ways = voices.withColumn("w", F.explode(keys)).groupBy("w.key").agg(F.min_by(F.struct("spec", "kind", "audio_path", "ref_text", "instruct"), F.struct("w.p", "spec")).alias("v"))
    rows = wanted.join(ways, wanted["spec"] == ways["key"], "left")
    return rows.select(wanted["spec"], F.col("v.kind").alias("kind"), F.col("v.audio_path").alias("audio_path"), F.coalesce(wanted["ref_text"], "v.ref_text").alias("ref_text"), F.col("v.instruct").alias("instruct"))


def found(voices: DataFrame, spec: str) -> DataFrame:
    """The voice of this spec, if there is one."""
    return voices.filter(F.col("spec") == spec)


def described(spec: Column, samples: Column, rate: Column, source: Column, ref_text: Column) -> Column:
    """What a model would hear of a voice, in one line."""
    mode = F.when(F.coalesce(ref_text, F.lit("")) == "", "timbre only (no transcript)").otherwise("timbre + prosody (transcript available)")
    return F.format_string("%s: %.1fs from %s — %s", spec, samples / rate, source, mode)
