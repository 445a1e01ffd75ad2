"""Prepared books as JSON files, and what lies below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import artifact
from ..operators.edits import EDIT

UNIT = f"struct<position:int,unit_id:string,kind:string,source_text:string,prepared_text:string,source_sha256:string,prepared_sha256:string,cache_key:string,edits:array<{EDIT}>,warnings:array<string>>"
BOOK = (
    "book_id string, title string, provider string, created_at string, complete boolean, prepared_text string, book_sha256 string, schema_version int, "
    f"chapters array<struct<index:int,title:string,source_text:string,normalized_text:string,prepared_text:string,prepared_sha256:string,units:array<{UNIT}>>>"
)
MANIFEST_NAME = "manifest.json"


def save_books(books: DataFrame, folder: str) -> None:
    """A JSON document a book, a file a book; Spark's committer makes the folder appear whole or not at all."""
    books.repartition("book_id").write.option("maxRecordsPerFile", 1).option("ignoreNullFields", "false").json(folder)


def load_books(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, chapters, units) of the artifacts below a path. Fields that are missing are null."""
    rows = spark.read.schema(BOOK).json(path, recursiveFileLookup=True)
    chapters = rows.select("book_id", F.explode("chapters").alias("c")).select("book_id", F.col("c.index").alias("chapter_index"), "c.*").drop("index")
    units = chapters.select("book_id", "chapter_index", F.explode("units").alias("u")).select("book_id", "chapter_index", "u.*")
    return rows.drop("chapters"), chapters.drop("units"), units


def violations(books: DataFrame, chapters: DataFrame, units: DataFrame) -> DataFrame:
    """(at, issue) of whole artifacts: schema version, titles, hashes, structure."""
    at = F.col("book_id")
    of_books = artifact._issue(books, ~F.col("schema_version").eqNullSafe(P.SCHEMA_VERSION), at, "unsupported schema version")
    of_books = of_books.unionByName(artifact._issue(books, F.coalesce(F.trim("title"), F.lit("")) == "", at, "blank book title"))
    truth = artifact.books_of(chapters).select("book_id", F.col("book_sha256").alias("own"))
    of_books = of_books.unionByName(artifact._issue(books.join(truth, "book_id", "left"), ~F.col("book_sha256").eqNullSafe(F.col("own")), at, "stale book hash"))
    twice = chapters.groupBy("book_id", "chapter_index").count().filter("count > 1")
    of_books = of_books.unionByName(artifact._issue(twice, F.lit(True), F.concat_ws("/", "book_id", "chapter_index"), "duplicate chapter"))
    return of_books.unionByName(artifact.chapter_violations(chapters, units)).unionByName(artifact.unit_violations(units))


def prepared_scripts(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of the prepared books below a folder; other JSON and manifests are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    body = F.decode("content", "UTF-8")
    own = F.contains(body, F.lit('"schema_version"')) & F.contains(body, F.lit('"chapters"')) & ~F.endswith("path", F.lit("/" + MANIFEST_NAME))
    return files.filter(own).select("path", "length", "modificationTime")


def newest(spark: SparkSession, root: str, suffix: str = "m4b") -> DataFrame:
    """(path, length, modificationTime) of finished books below a folder, newest first. The contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    return files.select("path", "length", "modificationTime").orderBy(F.desc("modificationTime"), "path")


def source_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size_bytes, media_type) of files."""
    from ..functions import native

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), native.media_type(F.col("path")).alias("media_type"))
