import json

import pytest
from pyspark.sql import functions as F

from lectern import catalogue
from lectern.functions import register
from lectern.operators import artifact
from lectern.plans import benchmark, prepare, report, review
from lectern.sources import files


def test_sql_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT normalize_text('a\nb'), word_tokens('A b'), strip_label(NULL)").first()[:] == ("a b", ["a", "b"], None)
    rows = spark.sql("SELECT * FROM sentence_spans('One here. Two.')").collect()
    assert [r["sentence"] for r in rows] == ["One here.", "Two."]
    assert spark.sql("SELECT output_text FROM change_regions('abc', 'axc')").collect()[0][0] == "x"
    assert spark.sql("SELECT text FROM narration_chunks('Some words.')").collect()[0][0] == "Some words."


def prepared(spark):
    chapters = spark.createDataFrame([("b", 0, "One", "It burned (Ng 1999, Li 2001). All of it was gone."), ("b", 1, "Two", "# Two\n\nMore of it [4] stood."), ("c", 0, "Solo", "Nothing else is here at all.")], "book_id string, chapter_index int, title string, source_text string")
    text = prepare.normalized(chapters)
    units = prepare.prepared_units(chapters)
    rows = text.join(artifact.chapters_of(units), ["book_id", "chapter_index"])
    books = artifact.books_of(rows).withColumns({"title": F.concat(F.lit("Book "), "book_id"), "provider": F.lit("rules"), "created_at": F.lit("2024"), "complete": F.lit(True)})
    return rows, units, books


def test_artifacts_round_trip_and_tampering(spark, tmp_path):
    rows, units, books = prepared(spark)
    files.save_books(artifact.nested(rows, units, books), str(tmp_path / "books"))
    b, c, u = files.load_books(spark, str(tmp_path / "books"))
    assert (b.count(), c.count(), u.count()) == (2, 3, 4)
    assert files.violations(b, c, u).count() == 0
    bad = u.withColumn("prepared_text", F.when(F.col("kind") == "heading", "# Tree").otherwise(F.col("prepared_text")))
    assert {r["issue"] for r in files.violations(b, c, bad).collect()} == {"structural text changed", "stale prepared hash", "chapter text differs from its units"}
    assert {r["issue"] for r in files.violations(b.withColumn("schema_version", F.lit(9)).withColumn("title", F.lit(" ")), c, u).collect()} == {"unsupported schema version", "blank book title"}
    assert {r["issue"] for r in files.violations(b, c.withColumn("prepared_sha256", F.lit("0")), u).collect()} == {"stale prepared hash", "stale book hash"}
    (tmp_path / "books" / "other.json").write_text('{"a": 1}')
    (tmp_path / "books" / files.MANIFEST_NAME).write_text('{"schema_version": 1, "chapters": []}')
    assert files.prepared_scripts(spark, str(tmp_path / "books")).count() == 2
    parts = [r["markdown"] for r in artifact.markdown(rows, books).filter("book_id = 'b'").orderBy("chapter_index").collect()]
    assert "\n\n".join(parts) + "\n" == "# Book b\n\n_Prepared by rules_\n\n## One\n\nIt burned. All of it was gone.\n\n# Two\n\nMore of it stood.\n"


def test_newest_and_metadata(spark, tmp_path):
    for n, t in (("a", 100), ("b", 200)):
        (tmp_path / f"{n}.m4b").write_bytes(b"x" * t)
        import os

        os.utime(tmp_path / f"{n}.m4b", (t, t))
    (tmp_path / "x.pdf").write_bytes(b"pdf")
    assert [r["length"] for r in files.newest(spark, str(tmp_path)).collect()] == [200, 100]
    got = files.source_metadata(spark, str(tmp_path / "x.pdf")).first()
    assert got["size_bytes"] == 3 and got["media_type"] == "application/pdf" and len(got["sha256"]) == 64


def test_report(spark):
    from test_edits_scores import EXPECT, GOLD, SOURCE, TRAPS

    cases = spark.createDataFrame(
        [("c1", "trap", ["citation"], SOURCE, GOLD, [{**EXPECT[0], "why": "", "sentence": 1}], [{**TRAPS[0], "start": 0, "end": 3, "label": "opening"}])],
        "id string, tier string, categories array<string>, source string, prepared string, expect array<struct<anchor:string,accept:array<string>,category:string,why:string,start:int,end:int,sentence:int>>, traps array<struct<label:string,start:int,end:int>>",
    )
    v = spark.createDataFrame([(n, n, r, 41 + r) for n in ("eager", "rules", "silent") for r in (1, 2)], "label string, model string, repetition int, seed int")
    runs = benchmark.case_runs(cases, v)
    text, body = report.report(runs.cache())
    data = json.loads(body)
    assert [m["label"] for m in data["models"]] == ["rules", "silent", "eager"] and "| `rules` | 1.000 | 2/2 | 0 | 100.0%" in text
    assert data["traps"] == [{"label": "eager", "trap": "opening", "failures": 2, "first_run": "eager/1/c1"}] and "### `eager`: c1 (0.00)" in text and "## By category" in text
    assert report.summary_line(data["models"][0]).startswith("1. rules")


def test_options(spark):
    o = benchmark.Options((" a ", "b"), (False, True, False), ("b",))
    rows = o.variants(spark).orderBy("label", "repetition").collect()
    assert [(r["label"], r["seed"]) for r in rows] == [("a", 42), ("a", 43), ("a +think", 42), ("a +think", 43), ("b", 42), ("b", 43)]
    for bad in ({"models": ()}, {"models": ("a", "a")}, {"models": ("a",), "repetitions": 0}, {"models": ("a",), "think": ()}):
        with pytest.raises(ValueError):
            benchmark.Options(**bad)


def test_review(spark):
    rows, units, books = prepared(spark)
    got = review.flagged(units).collect()
    assert [r["label"] for r in got] == ["ch 1 · unit 1 — 1 edit", "ch 2 · unit 2 — 1 edit"]
    assert "**Edits**\n\n- citation: “(Ng 1999, Li 2001)” → “” (not read aloud)" in got[0]["review"]
    said = {r["book_id"]: r["summary"] for r in review.summary(books, rows, units).collect()}
    assert said["b"] == "Book b: 2 prose units, 13 words, about 0 min; 2 edits, 0 units with warnings, 0 from an earlier run"


def test_book_markdown_renders_whole_documents(spark, tmp_path):
    docs = [(2, "b", " Two.\n\n" + "long text " * 40), (1, "b", "# chapter 1\nOwn title"), (3, "a", ""), (4, "a", "short\n"), (5, "a", None)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    parts = catalogue.QUERIES["book_markdown"](spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(parts, key=lambda r: (r["book_id"], r["chapter_index"] or 0)):
        got[r["book_id"]] = got.get(r["book_id"], []) + [r["markdown"]]
    chapter = lambda k, t: t if k == 1 else f"## Chapter {k}\n\n{t}"
    want = {b: [f"# {b}\n\n_Prepared by rules_"] + [chapter(k, t).strip() for k, s, t in sorted(docs, key=lambda d: d[0]) if s == b and t is not None] for b in ("a", "b")}
    assert got == want


def test_benchmark_report_takes_every_document_whole(spark, tmp_path):
    long = "A first line that is of middling length, as many of them are.\n" + "Then the text goes on for long. " * 60
    texts = ["Short.", long, long + "\n\nOne more (Ng 1999; Li 2001).", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["label"]: r for r in catalogue.QUERIES["benchmark_report"](spark, str(tmp_path)).collect()}
    assert {r["cases"] for r in got.values()} == {2 * len(texts)}
    assert got["rules"]["proposed_edits"] == 2 * (len(texts) + 1)  # the last citation lies beyond the first line
