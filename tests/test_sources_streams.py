import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL

from lectern.operators import artifact, audio
from lectern.plans import narrate, prepare, providers
from lectern.sources import corpus, markup, outline, voices
from lectern.streaming import resume

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'


def epub(nav=None, ncx=None, docs=(), spine=None, extra=""):
    items = [f'<item id="d{n}" href="d{n}.xhtml" media-type="application/xhtml+xml"/>' for n in range(len(docs))]
    files = {"META-INF/container.xml": CONTAINER}
    if nav:
        items.append('<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>')
        files["OPS/nav.xhtml"] = nav
    if ncx:
        items.append('<item id="ncx" href="t.ncx" media-type="application/x-dtbncx+xml"/>')
        files["OPS/t.ncx"] = ncx
    refs = spine or "".join(f'<itemref idref="d{n}"/>' for n in range(len(docs)))
    files["OPS/p.opf"] = f"<package><metadata><title>A  Book</title></metadata><manifest>{''.join(items)}{extra}</manifest><spine toc=\"ncx\">{refs}</spine></package>"
    files |= {f"OPS/d{n}.xhtml": d for n, d in enumerate(docs)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def page(body):
    return f"<html><head><title>no</title></head><body>{body}</body></html>"


def test_epub_by_nav_anchors():
    nav = '<html xmlns:epub="e"><body><nav epub:type="toc"><ol><li><a href="d0.xhtml#b">Beta</a></li><li><a href="d0.xhtml#a">Alpha</a></li><li><a href="d0.xhtml">Contents</a></li><li><a href="gone.xhtml">Gone</a></li></ol></nav></body></html>'
    book = markup.Epub(epub(nav=nav, docs=[page('<p>List</p><h2 id="a">Alpha</h2><p>First <b>part</b>.</p><h2 id="b">Beta</h2><p>Second.</p>')]))
    assert book.title == "A Book"
    assert book.chapters() == [("Alpha", "## Alpha\n\nFirst part."), ("Beta", "## Beta\n\nSecond.")]


def test_epub_by_ncx_over_documents():
    ncx = "<ncx><navMap>" + "".join(f"<navPoint><navLabel><text>{t}</text></navLabel><content src='{h}'/></navPoint>" for t, h in (("One", "d0.xhtml"), ("Two", "d2.xhtml"))) + "</navMap></ncx>"
    got = markup.Epub(epub(ncx=ncx, docs=[page(f"<p>{w}</p>") for w in ("One is here", "more", "Two", "rest *** END OF THE PROJECT GUTENBERG x")])).chapters()
    assert got == [("One", "# One is here\n\nmore"), ("Two", "# Two\n\nrest")]


def test_epub_without_navigation():
    spine = '<itemref idref="d0" linear="no"/><itemref idref="d1"/><itemref idref="d2"/>'
    got = markup.Epub(epub(docs=[page("<p>cover</p>"), page("<h1>Head<br/>line</h1><p>text</p>"), page("<p>plain</p>")], spine=spine)).chapters()
    assert got == [("Head line", "# Head line\n\ntext"), ("Section 2", "plain")]
    assert markup.Epub(epub(docs=[page("<p>only</p>")])).chapters() == [("Audiobook", "only")]


def test_epub_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        markup.Epub(b"no zip")
    (tmp_path / "a.epub").write_bytes(epub(docs=[page("<p>only</p>")]))
    (tmp_path / "b.EPUB").write_bytes(b"no zip")
    rows = {r["path"][-6:]: r for r in markup.read_epubs(spark, str(tmp_path)).collect()}
    assert rows["a.epub"]["source_text"] == "only" and "ZIP" in rows["b.EPUB"]["error"]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a&nbsp; b<script>x</script> c</p>", "a b c"), ("<h2>T<br>U</h2>x<br>y", "## T U\n\nx\ny"), ("<div>a</div><div>b</div>", "a\n\nb"),
        ("<ul><li>1</li><li>2</li></ul>", "1\n\n2"), ("a <i>b</i>c <svg><text>no</text></svg>d", "a bc d"), ("&lt;p&gt; caf&eacute;", "<p> café"), ("", ""),
    ],
)
def test_markdown(spark, html, want):
    got = spark.createDataFrame([(html,)], "html string")
    assert markup.to_markdown(got).first()["markdown"] == want


OUTLINE = "book_id int, ordinal int, level int, title string, page int"
PAGES = "book_id int, page_no int, markdown string"


def test_paged_book_by_numbered_bookmarks(spark):
    pages = [(1, 1, "Preface\nwe begin"), (1, 2, "II Part"), (1, 3, "1\nAlpha starts here and is bro-"), (1, 4, "ken off."), (1, 5, "Beta\n\nNew page."), (1, 6, "End of it.")]
    marks = [(1, 0, 1, "II Part", 2), (1, 1, 2, "1 Alpha", 4), (1, 2, 2, "2 Beta", 5), (1, 3, 1, " ", 6), (1, 4, 1, "9 Lost", -1)]
    rows = outline.paged_chapters(spark.createDataFrame(pages, PAGES), spark.createDataFrame(marks, OUTLINE)).orderBy("chapter_index").collect()
    assert [(r["title"], r["source_text"]) for r in rows] == [("Preface", "# Preface\nwe begin"), ("1 Alpha", "# Alpha starts here and is broken off."), ("2 Beta", "# Beta\n\nNew page.\n\nEnd of it.")]


def test_paged_book_by_level_headings_or_whole(spark):
    pages = [(1, 1, "Cover"), (1, 2, "One text"), (1, 3, "Two text"), (2, 1, "# A\n\nx\n\n# B\n\ny\n\n## C\n\nz"), (3, 1, "just"), (3, 2, "text")]
    marks = [(1, 0, 1, "Cover", 1), (1, 1, 1, "One", 2), (1, 2, 2, "Sub", 2), (1, 3, 1, "Two", 3), (3, 0, 1, "Only", 1)]
    rows = outline.paged_chapters(spark.createDataFrame(pages, PAGES), spark.createDataFrame(marks, OUTLINE)).orderBy("book_id", "chapter_index").collect()
    assert [(r["book_id"], r["title"], r["source_text"]) for r in rows] == [(1, "One", "# One text"), (1, "Two", "# Two text"), (2, "A", "# A\n\nx"), (2, "B", "# B\n\ny\n\n## C\n\nz"), (3, "Audiobook", "just\n\ntext")]


def test_join_pages():
    assert outline.join_pages(["He went", None, "# on and", "Next. bro-", "ken", " "]) == "He went on and\n\nNext. broken"
    assert outline.book_format("a/B.EPUB") == "epub"
    with pytest.raises(ValueError):
        outline.book_format("x.txt")


def test_corpus(spark, tmp_path):
    source = "The mill burned down (Ng 1999, Li 2001). Nobody came to see it for years."
    good = {"id": "core-1", "tier": "core", "categories": ["citation"], "source": source, "prepared": "The mill burned down. Nobody came to see it for years.", "expect": [{"anchor": "(Ng 1999, Li 2001)", "accept": [""], "category": "citation"}], "traps": [{"span": "Nobody", "label": "subject"}]}
    bad = {"core-2": {**good, "id": "core-2", "prepared": source}, "core-3": {**good, "id": "x", "expect": [{"anchor": "e", "accept": [""]}]}, "trap-1": {**good, "id": "trap-1", "tier": "trap", "traps": []}}
    for name, case in {"core-1": good, **bad}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(case))
    rows = {r["id"]: r for r in corpus.read_cases(spark, str(tmp_path)).collect()}
    assert rows["core-1"]["issues"] == [] and rows["core-1"]["expect"][0]["start"] == 21 and rows["core-1"]["expect"][0]["sentence"] == 1
    assert "nothing differs" in rows["core-2"]["issues"][0] and "times" in rows["x"]["issues"][0] and "bait" in rows["trap-1"]["issues"][0]
    assert [r["id"] for r in rows.values() if not r["issues"]] == ["core-1"]
    few = corpus.selected(corpus.read_cases(spark, str(tmp_path)), tiers=["core"], categories=["citation"], per_tier=1)
    assert [r["id"] for r in few.collect()] == ["core-1"]


def test_every_rule_of_cases(spark, tmp_path):
    source = "The mill burned down (Ng 1999, Li 2001). Nobody came to see it for years."
    good = {"id": "a-1", "tier": "core", "categories": ["citation"], "source": source, "prepared": "The mill burned down. Nobody came to see it for years.", "expect": [{"anchor": "(Ng 1999, Li 2001)", "accept": [""], "category": "citation"}], "traps": []}
    idle = {**good, "prepared": source, "expect": [], "categories": ["no_edit"], "tier": "noop"}
    anchor = good["expect"][0]
    odd = [
        (good, []), (idle, []), ({**good, "id": "A_1"}, ["lower case", "file's name"]), ({**good, "tier": "x"}, ["unknown tier"]), ({**good, "tier": "trap"}, ["bait"]),
        ({**good, "categories": []}, ["no category"]), ({**good, "categories": ["citation", "q"]}, ["unknown category “q”"]), ({**good, "source": " ", "expect": []}, ["blank"]),
        ({**idle, "source": "# Part\n\nIt was so.", "prepared": "# Part\n\nIt was so."}, ["one unit of prose"]), ({**good, "expect": [{**anchor, "accept": []}]}, ["accepts nothing"]),
        ({**good, "expect": [{**anchor, "category": "no_edit"}]}, ["no edit has the category"]), ({**good, "expect": [{**anchor, "anchor": "2001). Nobody"}]}, ["end of a sentence"]),
        ({**good, "expect": [anchor, {**anchor, "anchor": "Li 2001"}]}, ["are both expected and overlap"]), ({**good, "traps": [{"span": "Ng 1999", "label": "t"}]}, ["the trap “t” forbids"]),
        ({**good, "categories": ["citation", "no_edit"]}, ["does not go with"]), ({**good, "prepared": source}, ["nothing differs"]), ({**idle, "prepared": "x"}, ["has to be the source"]),
        ({**idle, "categories": ["citation"]}, ["no_edit is wanted"]), ({**idle, "tier": "core"}, ["noop or robustness"]), ({**good, "expect": [{**anchor, "accept": ["", "in a great many words indeed here"]}]}, ["expect[0] as “in a great many"]),
        ({**good, "prepared": "Else."}, ["the outcome is “The mill burned down."]), ({**good, "expect": [{**anchor, "anchor": ""}]}, ["it is empty"]),
    ]
    for n, (case, _) in enumerate(odd):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "a-1.json").write_text(json.dumps({**case, "notes": str(n)}))
    got = {int(r["notes"]): r["issues"] for r in corpus.read_cases(spark, str(tmp_path)).collect()}
    for n, (_, words) in enumerate(odd):
        assert len(got[n]) == len(words) and all(any(w in x for x in got[n]) for w in words), (n, got[n])


def test_voices(spark, tmp_path):
    for name, meta in (("anna", '{"ref_text": "hello", "instruct": "warm"}'), ("bert", "{not json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "reference.json").write_text(meta)
        (tmp_path / name / "reference.wav").write_bytes(b"x")
    (tmp_path / "cleo.WAV").write_bytes(b"x")
    (tmp_path / "cleo.txt").write_text(" hi ")
    found = voices.reference_voices(spark, str(tmp_path))
    assert sorted((r["kind"], r["ref_text"]) for r in found.collect()) == [("designed", "hello"), ("recording", "hi")]
    roster = spark.createDataFrame([("Anna",), ("Dora",)], "name string")
    assert [r["label"] for r in voices.catalogue(found, roster).filter("ordinal = 2").collect()] == ["Dora  (built-in)"]
    asked = spark.createDataFrame([("anna", None), ("cleo.WAV", "mine"), ("zed", None)], "spec string, ref_text string")
    got = {r["spec"]: (r["kind"], r["ref_text"]) for r in voices.resolved(asked, found).collect()}
    assert got == {"anna": ("designed", "hello"), "cleo.WAV": ("recording", "mine"), "zed": (None, None)}


CHAPTERS = "book_id string, chapter_index int, title string, source_text string"
ROWS = [("b", 0, "One", "# One\n\nIt burned (Ng 1999, Li 2001). All of it was gone by then.\n\n***\n\nThe rest of it stood [4]."), ("b", 1, "Two", None)]


def test_preparation_resumes(spark):
    chapters = spark.createDataFrame(ROWS, CHAPTERS)
    first = prepare.prepared_units(chapters)
    rows = first.orderBy("position").collect()
    assert [r["prepared_text"] for r in rows] == ["# One", "It burned. All of it was gone by then.", "***", "The rest of it stood."]
    assert [r["cache_hit"] for r in rows] == [False] * 4 and not any(r["issues"] for r in rows)
    cache = artifact.latest(first.filter("cache_key is not null").select("cache_key", *prepare.CACHED, F.lit(1).alias("w")), "w").drop("w")
    again = prepare.prepared_units(chapters, cache=cache).orderBy("position").collect()
    assert [r["cache_hit"] for r in again] == [False, True, False, True] and [r["prepared_text"] for r in again] == [r["prepared_text"] for r in rows]
    other = prepare.prepared_units(chapters, provider="silent", cache=cache)
    assert other.filter("cache_hit").count() == 0
    assert artifact.unit_violations(first).count() == 0
    assert prepare.prepared_units(chapters, most_prose=1).count() == 3


def test_spoilt_answers_are_flagged(spark):
    chapters = spark.createDataFrame(ROWS, CHAPTERS)
    keys = [r["cache_key"] for r in prepare.prepared_units(chapters).filter("cache_key is not null").orderBy("position").collect()]
    cache = prepare.prepared_units(chapters).filter("cache_key is not null").select("cache_key", *prepare.CACHED)
    spoilt = cache.withColumn("prepared_text", F.when(F.col("cache_key") == keys[0], " ").otherwise(F.col("prepared_text")))
    got = prepare.prepared_units(chapters, cache=spoilt).filter("kind = 'prose'").orderBy("position").collect()
    assert [r["cache_hit"] for r in got] == [True, True] and [len(r["issues"]) for r in got] == [1, 0]
    strict = prepare.answered(
        prepare.requests(artifact.identified(prepare.segment.units(prepare.normalized(chapters), keys=("book_id", "chapter_index", "title"))), "rules")
        .join(cache.select("cache_key", F.struct(*prepare.CACHED).alias("cached")), "cache_key", "left"), "rules", prepare.Policy(retention=1.0),
    )
    assert {r["cache_hit"] for r in strict.filter("kind = 'prose'").collect()} == {True}


def test_guards_and_previews(spark):
    for bad in ({"preview_chapters": 0}, {"preview_units": -1}, {"preview_chunks": 0}, {"timeout_seconds": 0}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            prepare.Options(**bad)
    rows = spark.createDataFrame([(b, k, "t", "Text of it.") for b in "ab" for k in range(5)], CHAPTERS)
    few = prepare.Options(preview_chapters=2).chapters(rows)
    assert sorted((r["book_id"], r["chapter_index"]) for r in few.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert prepare.Options(preview_chapters=2, preview_units=1).prepared(rows).filter("kind = 'prose'").count() == 2
    assert prepare.Options().chapters(rows) is rows
    with pytest.raises(ValueError):
        prepare.first_chapters(rows, 0)
    with pytest.raises(ValueError, match="v4, v5, v6"):
        providers.request_body("a", prompt_version="v9")
    assert json.loads(providers.request_body("A b. C d."))["prompt_version"] == "v6"


def test_the_stores_last_answer_counts(spark, tmp_path):
    store = str(tmp_path / "store")
    row = lambda text, number: spark.createDataFrame([("ab1", text, [], [], "p", "m", [], number, "ab"), ("cd2", "x", [], [], "p", "m", [], number, "cd")], resume.STORED)
    for text, number in (("old", 1), ("new", 3), ("mid", 2)):
        row(text, number).write.mode("append").partitionBy("part").parquet(store)
    assert {r["cache_key"]: r["prepared_text"] for r in resume.stored(spark, store).collect()} == {"ab1": "new", "cd2": "x"}
    assert [r["cache_key"] for r in resume.stored(spark, store, ["ab"]).collect()] == ["ab1"]


def test_stream_asks_once(spark, tmp_path):
    units = prepare.prepared_units(spark.createDataFrame(ROWS, CHAPTERS)).select("book_id", "chapter_index", "title", "position", "kind", F.col("source_text").alias("text"))
    units = units.withColumns({"previous_context": F.lit(""), "following_context": F.lit("")})
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for _ in range(2):
        units.write.mode("append").parquet(source)
        resume.start(spark.readStream.schema(units.schema).parquet(source), store, str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(store).count() == 2
    assert resume.stored(spark, str(tmp_path / "none")) is None


def test_providers():
    assert providers.preparers.names() == ["eager", "flaky", "rules", "silent"]
    with pytest.raises(ValueError):
        providers.preparers.create("nope")
    with pytest.raises(ValueError):
        providers.preparers.register("Rules", providers.Rules)
    got, warnings = providers.parsed_response('```json\n{"edits": [{"original": "a", "sentence": "x"}], "warnings": ["w"]}\n```')
    assert (got[0].category, got[0].sentence, warnings) == ("unspecified", 0, ["w"])
    for body in ("[]", "{", '{"edits": {}}', '{"warnings": [1]}'):
        with pytest.raises(providers.ProviderError):
            providers.parsed_response(body)
    lines = providers.progress_lines("m", [{"status": "a"}, {"status": "a"}, {"status": "p", "total": 2048, "completed": 1100}, {}])
    assert lines == ["  pulling m: a", "  pulling m: p 50% of 2 KB"]
    assert providers.trustworthy_transcript("two words", 5) is None and providers.trustworthy_transcript("two words", 4) == "two words"


RATE = 1000


def test_audio_joins():
    a = np.ones(100, np.float32)
    assert len(audio.crossfade(a, a, 30)) == 170 and np.allclose(audio.crossfade(a, a, 30), 1)
    joined = audio.assembled(["continuation", "paragraph", "scene"], [a, a, a], RATE)
    assert len(joined) == 170 + 150 + 100 == audio.joined_length([100] * 3, ["continuation", "paragraph", "scene"], RATE)
    assert joined[169] == 0 and joined[320] == 0 and joined[0] == 1
    assert len(audio.assembled([], [], RATE)) == 0
    with pytest.raises(ValueError):
        audio.assembled(["paragraph"], [], RATE)


def test_levels():
    t = np.arange(2000) / RATE
    tone = (0.2 * np.sin(2 * np.pi * 50 * t)).astype(np.float32)
    base = audio.level(tone, RATE)
    assert abs(base - 0.2 / 2**0.5) < 1e-3
    assert abs(audio.level(np.concatenate([np.zeros(3000, np.float32), tone]), RATE) - base) < 1e-6
    assert audio.level(np.array([np.nan, 1]), RATE) == 0 == audio.level(np.zeros(0), RATE) == audio.level(np.full(500, 1e-4), RATE)


def test_native_level_equals_numpy(spark):
    r = np.random.default_rng(1)
    signals = [r.normal(0, 0.1, n).astype(np.float32) for n in (500, 49, 173)] + [np.zeros(100, np.float32), np.array([np.inf], np.float32), np.zeros(0, np.float32)]
    df = spark.createDataFrame([(n, s.tolist()) for n, s in enumerate(signals)], "id int, samples array<float>")
    got = {r["id"]: r["active_rms"] for r in audio.active_rms(df, ("id",), frame=50).collect()}
    assert all(abs(got[n] - audio.level(s, RATE)) < 1e-9 for n, s in enumerate(signals))


def test_matching(spark):
    t = np.arange(1000) / RATE
    rows = [("b", 0, n, "t", "paragraph", 1, (a * np.sin(2 * np.pi * 50 * t)).astype(np.float32).tolist()) for n, a in enumerate((0.1, 0.12, 0.9, 0.0))]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, chunk_index int, text string, boundary_after string, char_count int, samples array<float>")
    got = {r["chunk_index"]: r for r in narrate.levelled(df, RATE).collect()}
    assert abs(got[1]["gain_db"]) < 0.01 and abs(got[2]["gain_db"] + 3) < 1e-9 and got[3]["gain_db"] == 0 and 1.5 < got[0]["gain_db"] < 1.6
    assert abs(max(got[0]["samples"]) - 0.12) < 1e-3
    times = narrate.timeline(df, RATE).first()
    assert (times["start_ms"], times["end_ms"]) == (0, 4 * 1000 + 3 * 150 + 500)


def test_voice_clip_is_trimmed():
    tone = np.sin(np.arange(12_000) / 5).astype(np.float32)
    quiet = np.zeros(24_000, np.float32)
    cut = audio.trimmed(np.concatenate([quiet, tone, quiet, tone, quiet]), 24_000)
    assert 24_000 + 7200 <= len(cut) <= 24_000 + 7200 + 2 * 1200 + 6 * 2048
    assert abs(np.abs(audio.peak_scaled(tone)).max() - 10 ** (-3 / 20)) < 1e-6
    assert audio.wav(tone, 24_000)[:4] == b"RIFF" and "print_format" in audio.loudnorm_filter()


def test_citations_that_open_a_paragraph_stay(spark):
    rules, mark = providers.preparers.create("rules"), "(Smith 1999, Jones 2001)"
    said = lambda t: [e.original for e in rules.propose(t)]
    assert said(f"{mark} went on.") == said(f"It ended.\n\n{mark} went on.") == said("[7] again.") == []
    assert said(f"It {mark} went on. Seen [7] again.") == [mark, "[7]"] and said(f" {mark}") == [mark]
    chapters = spark.createDataFrame([("a", 4, "T", f"# One\n{mark} went on."), ("a", 8, "T", f"It {mark} went on.")], "book_id string, chapter_index int, title string, source_text string")
    got = {(r["chapter_index"], r["position"]): (r["prepared_text"], len(r["edits"])) for r in prepare.prepared_units(chapters).collect()}
    assert got[4, 1] == (f"{mark} went on.", 0) and got[8, 0] == ("It went on.", 1)


def test_manifest_holds_no_signals(spark, monkeypatch):
    from lectern import catalogue

    texts = ["One two. " * n for n in (1, 9, 40, 300)]
    rows = spark.createDataFrame([("b", k % 2, k, t, "paragraph", len(t)) for k, t in enumerate(texts)], "book_id string, chapter_index int, chunk_index int, text string, boundary_after string, char_count int")
    short = narrate.measured(rows, rate=RATE)
    assert "samples" not in short.columns
    want = narrate.manifest(narrate.levelled(narrate.spoken(rows, rate=RATE), RATE), RATE)
    assert sorted(narrate.manifest(narrate.matched(short), RATE).collect()) == sorted(want.collect())
    monkeypatch.setattr(narrate, "SAMPLES", 5000)  # a portion is full with the chunk that reaches it
    said = [(len(batch), sum(len(s) for s, _ in made)) for batch, made in narrate._said("tone", {"rate": RATE}, iter([rows.toPandas()]))]
    assert [n for n, _ in said] == [3, 1] and sum(n for _, n in said) == sum(r["n_samples"] for r in short.collect())
    monkeypatch.setattr(narrate, "spoken", None)
    assert " samples#" not in catalogue.QUERIES["narration_manifest"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
