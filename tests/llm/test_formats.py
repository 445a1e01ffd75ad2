import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lectern.llm import common, packing, preference, sharding, warc

DOCS = "doc_id long, text string"


# Packing


def check_packing(rows, texts, capacity):
    """Every document whole and in order, every sequence gapless and within capacity."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for k, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[k] = [(p, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for p, at in enumerate(range(0, len(ids), capacity))]
    got, places = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark):
    r = np.random.default_rng(0)
    texts = [(k, " ".join(["word"] * int(r.integers(0, 60)))) for k in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "long text " * 500), (1003, "İ <|endoftext|> 日本 é it's"), (1004, "x" * 3000)]
    df = spark.createDataFrame(texts, DOCS).withColumn("length", F.lit("old")).withColumn("k", F.lit(0))
    rows = packing.pack(df, capacity=64).collect()
    room = []  # first fit decreasing
    for length in sorted((x["length"] for x in rows), reverse=True):
        at = next((k for k, free in enumerate(room) if free >= length), None)
        if at is None:
            room.append(64 - length)
        else:
            room[at] -= length
    assert check_packing(rows, texts, 64) <= 1.01 * len(room) + 1
    assert packing.pack(df.limit(0), capacity=64).count() == 0


def test_repeated_rows_are_packed_each(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a b c")] * 5 + [(None, "a")], DOCS), capacity=8, rows_per_bucket=2).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6


def test_ids_beside_a_null_stay(spark):
    ids = [2**53 + 1, 2**53 + 3, -(2**63), None]
    rows = packing.pack(spark.createDataFrame([(k, "a b") for k in ids], DOCS).coalesce(1), capacity=8).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["doc_id"] is not None) == sorted((False, k) for k in ids if k is not None) and len(rows) == 4
    with pytest.raises(ValueError):
        packing.patterns(np.arange(1, 9), 1 << 20)


def test_all_documents_of_the_smallest_table(spark):
    texts = [tuple(r) for r in common.read(spark, SMALL, "documents").select("doc_id", "text").collect()]
    rows = packing.op1_best_fit_packing(spark, SMALL).collect()
    assert check_packing(rows, texts, 2048) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def file_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("window, places, most, apart, ids", [(1 << 18, 1 << 16, 1 << 15, 1000, 1 << 20), (64, 256, 200, 5, 300), (20, 8, 1000, 5, 300), (20, 64, 30, 5, 300)])
def test_words_get_the_files_ids_however_little_is_remembered(monkeypatch, window, places, most, apart, ids):
    for name, value in {"WINDOW": window, "PLACES": places, "REMEMBERED": most, "APART": apart, "IDS": ids}.items():
        monkeypatch.setattr(packing, name, value)
    r = np.random.default_rng(window + places + most)
    plain = "'|'s|'S|'ll|'re|'r|'l|'ve|'t|'m|'d|'v|a|b|ll|E|é|É|Ÿ|ſ|ß|ł|Ł|0|12| |  |\n|\t|\r|.|,|!?|=|\"|-|_|<|>|the|qwertyuiopas".split("|") + ["x" * 17, "<|"]
    odd = [*plain, "<|endoftext|>", "日", "İ", "ŉ", "×", "\0", "\xa0", "e\u0301"]
    words = packing.WordTokenizer(common.tokenizer_path("word_bpe_49k.json"))
    for _ in range(60):
        texts = ["".join(r.choice(odd if r.random() < 0.2 else plain, int(r.integers(0, 60)))) for _ in range(20)]
        texts += ["", None, " ", "'", "'s", "'re", "'r", "'l", "''s", "'s's", "'sa's0", "'s.", "'ll!", "0'0", "y" * 3000]
        assert words.encode(texts) == file_ids(texts)
    assert words.encode([]) == []


def test_known_words_are_not_learned_again(monkeypatch):
    learned, own = [], packing.WordTokenizer._learn
    monkeypatch.setattr(packing.WordTokenizer, "_learn", lambda self, new: learned.append(len(new)) or own(self, new))
    words = packing.WordTokenizer(common.tokenizer_path("word_bpe_49k.json"))
    letters = np.array(list("abcdefghijklmnop"))
    texts = [" ".join("".join(letters[[k >> s & 15 for s in (16, 12, 8, 4, 0)]]) for k in range(at, at + 3000)) for at in range(0, 300_000, 3000)]
    for _ in range(2):
        got = [x for t in texts for x in words.encode([t])]
    assert sum(learned) == 300_000
    assert got[::20] == file_ids(texts[::20])


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_all_documents(seed):
    r = np.random.default_rng(seed)
    h = np.bincount(r.integers(1, 101, 3000) if seed % 2 else np.minimum(100, r.exponential(20, 2000).astype(int) + 1), minlength=101)
    planned = packing.plan(h)
    got = np.zeros(101, int)
    for shape, n in planned:
        assert sum(shape) <= 100 and n > 0
        np.add.at(got, list(shape), n)
    assert (got == h).all()
    assert sum(n for _, n in planned) <= 1.03 * -(-(h * np.arange(101)).sum() // 100) + 2


def test_patterns_fill_a_sequence():
    p = packing.patterns(np.arange(1, 30), 30)
    assert (p.sum(axis=1) == 30).all() and len(np.unique(p, axis=0)) == len(p)
    assert {tuple(x) for x in p} == {(a, b, c) for a in range(30) for b in range(a + 1) for c in range(b + 1) if a + b + c == 30 and b and a < 30}


def test_fit_lowers_the_error():
    h = np.bincount(np.random.default_rng(0).integers(1, 40, 4000), minlength=41).astype(float)
    p = packing.patterns(np.flatnonzero(h), 40)
    error = lambda x: ((np.bincount(p.ravel(), np.repeat(x, 3), 41)[1:] - h[1:]) ** 2 * np.arange(1, 41)).sum()
    assert error(packing.fit(p, h, 300)) < error(packing.fit(p, h, 3)) and (packing.fit(p, h) >= 0).all()


# Sharding


def test_table_versions(spark, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, smallest=1 << 12)
    with pytest.raises(ValueError):
        table.read()
    df = spark.range(2000).withColumn("text", F.when(F.col("id") % 5 > 0, F.repeat(F.col("id").cast("string"), 20)))
    for part in range(6):
        table.append(df.filter(F.col("id") % 6 == part).repartition(3))
    before = table.manifest()
    assert before["version"] == 6 and len(before["shards"]) == 18
    after = table.manifest(table.compact())
    assert len(after["shards"]) < 4 and table.read().exceptAll(df).count() == 0 and table.read().count() == 2000
    assert table.read(6).count() == 2000 and table.read(2).count() < 700
    assert table.vacuum() == 18 and table.read().count() == 2000
    table.append(df.limit(0))
    assert table.read().count() == 2000
    assert table.compact() == table.version()


def test_two_writers_conflict(spark, tmp_path):
    a, b = (sharding.ShardedTable(spark, str(tmp_path / "t")) for _ in "ab")
    a.append(spark.range(3))
    schema = spark.range(1).schema.json()
    b.commit(2, schema, [])
    with pytest.raises(sharding.Conflict):
        a.commit(2, schema, [])
    assert a.version() == 2 and a.read().count() == 0 and a.read(1).count() == 3


def test_vacuum_spares_what_is_being_written(spark, tmp_path, monkeypatch):
    a, b = (sharding.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, smallest=1 << 12) for _ in "ab")
    a.append(spark.range(5))
    commit, calls = a.commit, []

    def late(*args):  # between an append's write and its commit another writer vacuums, appends and vacuums again
        if not calls:
            calls.append(b.vacuum())
            b.append(spark.range(100, 103))
            calls.append(b.vacuum())
        return commit(*args)

    monkeypatch.setattr(a, "commit", late)
    a.append(spark.range(10, 15))
    assert calls == [0, 0] and a.version() == 3 and sorted(r["id"] for r in a.read().collect()) == [*range(5), *range(10, 15), 100, 101, 102]
    assert b._list("leases") == [] and b.vacuum() == 0


def test_a_failed_append_leaves_nothing(spark, tmp_path, monkeypatch):
    t = sharding.ShardedTable(spark, str(tmp_path / "t"))
    t.append(spark.range(3))
    monkeypatch.setattr(t, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.append(spark.range(9))
    assert len(t._list("shards")) == 1 and t._list("leases") == [] and t.read().count() == 3


def test_a_lost_writers_files_and_claim_are_taken_over(spark, tmp_path):
    t = sharding.ShardedTable(spark, str(tmp_path / "t"), lease_s=3600)
    t.append(spark.range(3))
    t._create("manifests/.claim-00000002", "lost")
    spark.range(7).write.parquet(str(tmp_path / "t/shards/append-lost"))
    t._create("leases/append-lost", "append-lost")
    with pytest.raises(sharding.Conflict):
        t.append(spark.range(3, 5), tries=2)
    assert t.vacuum() == 0 and len(t._list("shards")) == 2
    heir = sharding.ShardedTable(spark, str(tmp_path / "t"), lease_s=-1)
    assert heir.append(spark.range(3, 5)) == 2 and sorted(r["id"] for r in heir.read().collect()) == [*range(5)]
    assert heir.vacuum() > 0 and heir.read().count() == 5 and len(heir._list("shards")) == 2


def test_a_merge_holds_upon_later_appends(spark, tmp_path, monkeypatch):
    a, b = (sharding.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, smallest=1 << 12) for _ in "ab")
    for n in range(4):
        a.append(spark.range(10 * n, 10 * n + 10).coalesce(1))
    commit, calls = a.commit, []
    monkeypatch.setattr(a, "commit", lambda *x: (calls.append(1) or len(calls) == 1 and b.append(spark.range(90, 93).coalesce(1)), commit(*x))[1])
    a.compact()
    assert len(a.manifest()["shards"]) == 2 and sorted(r["id"] for r in a.read().collect()) == [*range(40), 90, 91, 92]
    calls.clear()
    for n in range(4):
        b.append(spark.range(3).coalesce(1))
    monkeypatch.setattr(a, "commit", lambda *x: (calls.append(1) or len(calls) == 1 and b.compact(), commit(*x))[1])
    with pytest.raises(sharding.Conflict):
        a.compact()
    assert b.read().count() == 55


def test_foreign_columns_are_refused(spark, tmp_path):
    t = sharding.ShardedTable(spark, str(tmp_path / "t"))
    t.append(spark.createDataFrame([(1, "a")], DOCS))
    for other in ("doc_id long", "doc_id long, text string, x int", "doc_id int, text string"):
        with pytest.raises(ValueError):
            t.append(spark.createDataFrame([], other))
    t.append(spark.createDataFrame([("b", 2)], "text string, doc_id long"))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "b")] and t.version() == 2


def test_runs_are_similar_and_near_the_target(spark, tmp_path):
    t = sharding.ShardedTable(spark, str(tmp_path), target=100, fan_in=4, smallest=10)
    s = [sharding.Shard(str(k), size, t.tier(size)) for k, size in enumerate([5] * 9 + [30] * 3 + [35] * 5 + [80, 120])]
    runs = t.runs(s)
    assert all(len({x.tier for x in r}) == 1 and sum(x.size for x in r) <= 100 for r in runs) and not any(x.size >= 50 for r in runs for x in r)
    assert t.runs(s[:3]) == []


# WARC

PAGES = [(1, "http://a.b/c", '<html lang="EN"><head><title>T &amp; U</title><meta name="d" content="x"></head><body><script>no</script><p>A &lt;b</p><p>c<br>d <a href="/e">f</a></p></body></html>'), (2, None, None), (3, "http://x/ü", ""), (1, "http://a.b/c", "<p>same id"), (None, "http://n", "<p>é\r\n\r\nWARC/1.1</p>"), (4, "http://l", "<p>" + "long " * 60_000)]


def test_derivatives(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("block", F.lit("old"))
    source = warc.responses(df)
    got = warc.derive(source)
    assert got.count() == 2 * len(PAGES) == 2 * source.count()
    by = {(r["page_id"], r["record_type"], r["refers_to"]): r for r in got.collect()}
    first = next(r for r in source.collect() if r["page_id"] == 1 and "lang" in r["block"])
    text, about = by[1, "conversion", first["record_id"]], by[1, "metadata", first["record_id"]]
    assert text["block"] == "A <b\nc\nd f" and text["payload_digest"] == first["payload_digest"] == warc.digest(PAGES[0][2].encode()) and text["http_headers"] == first["http_headers"]
    assert '"title": "T & U"' in about["block"] and '"url": "http://a.b/e"' in about["block"] and '"lang": "en"' in about["block"] and first["record_id"] in about["block"]
    assert text["block_digest"] == warc.digest(text["block"].encode()) and text["content_length"] == len(text["block"].encode())
    assert len({r["record_id"] for r in got.collect()}) == got.count()
    assert warc.derive(source.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    source = warc.responses(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    records = source.drop("page_id").unionByName(warc.derive(source).drop("page_id"))
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert key(back.collect()) == key(records.select(back.columns).collect())
    warc.write_warc(records, str(tmp_path / "many"), records_per_file=2)
    assert key(warc.read_warc(spark, str(tmp_path / "many")).collect()) == key(back.collect()) and len(list((tmp_path / "many").glob("*.gz"))) >= 9


def test_line_breaks_in_fields_are_encoded(spark, tmp_path):
    odd = warc.responses(spark.createDataFrame([(1, "http://a/\r\nX: y", "p")], "page_id long, url string, html string")).drop("page_id")
    warc.write_warc(odd, str(tmp_path / "w"))
    assert [r["target_uri"] for r in warc.read_warc(spark, str(tmp_path / "w")).collect()] == ["http://a/%0D%0AX: y"]


def test_record_ids_depend_on_their_page_alone(spark):
    rows = [(1, "http://a", "x"), (2**53 + 1, "http://b", "y"), (None, "http://c", "z"), (2**53 + 3, None, None)]
    make = lambda some: {r["page_id"]: r["record_id"] for r in warc.derive(warc.responses(spark.createDataFrame(some, "page_id long, url string, html string").coalesce(1))).filter("record_type = 'metadata'").collect()}
    whole = make(rows)
    assert set(whole) == {r[0] for r in rows} and len(set(whole.values())) == 4
    for row in rows:
        assert make([row]) == {row[0]: whole[row[0]]}


TAGS = ["<p>", "</p>", "<br>", "<b>", "</b>", "<div>", "</div>", "<!-- c -->", "<script>s</script>", "<style>t</style>", " ", "word", "&amp;", "é"]


def test_plain_text_by_a_parser():
    """Against the standard library's parser on random pages without heads or unclosed tags."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.quiet = [], 0

        def handle_starttag(self, tag, attrs):
            self.quiet += tag in ("script", "style")
            self.out += "\n" if tag in ("p", "br", "div") else " " if self.quiet else ""

        def handle_endtag(self, tag):
            self.quiet -= tag in ("script", "style")
            self.out += "\n" if tag in ("p", "div") else ""

        def handle_comment(self, data):
            self.out += " "

        def handle_data(self, data):
            self.out += data if not self.quiet else ""

    r = np.random.default_rng(3)
    for _ in range(300):
        page = "".join(r.choice(TAGS, 12))
        reader = Reader()
        reader.feed(page)
        reader.close()
        lines = [" ".join(x.split()) for x in "".join(reader.out).split("\n")]
        assert warc.plain_text(page) == "\n".join(x for x in lines if x)


# Preference

TURNS = "conv_id long, turn long, role string, text string"


def turns(conv, *texts, first="user"):
    roles = (["system"] if first == "system" else []) + ["user", "assistant"] * 9
    return [(conv, n, roles[n], t) for n, t in enumerate(texts)]


def test_pairs(spark):
    rows = turns(1, "hi", "yo") + turns(2, "hi", "hello there") + turns(3, "hi", "yo", "more", "again") + turns(4, "alone", None) + turns(4, "alone", None)[:1] + [(None, 0, "user", "x"), (5, 0, None, "hm")]
    c = preference.assembled(spark.createDataFrame(rows, TURNS).withColumn("x", F.lit(0)))
    assert c.count() == 5
    opening = sorted((r["chosen_id"], r["rejected_id"]) for r in preference.opening_pairs(c).collect())
    assert opening == [(2, 1), (2, 3)]
    replay = preference.replay_pairs(c).collect()
    assert [(r["chosen_id"], [t["text"] for t in r["rejected"]]) for r in replay] == [(3, ["hi", "yo", "more", "yo"])]


def test_formatting_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    rows = turns(1, "sys", "hi", "yo <|endoftext|>", "é 日本", "end", first="system") + turns(2, "sys", "hi", "yo <|endoftext|>", "other", "x", first="system") + turns(3, "same") + turns(4, "same")
    pairs = preference.opening_pairs(preference.assembled(spark.createDataFrame(rows, TURNS)))
    got = {r["rejected_id"]: r for r in preference.format_pairs(pairs.withColumn("prompt_ids", F.lit("x")).drop("prompt_ids")).collect()}
    r = got[min(got, key=lambda k: (k not in (1, 2), k))]
    assert r["common_turns"] == 3 and r["prompt"] == "<|system|>\nsys<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nyo <|endoftext|><|end|>\n"
    for side in ("chosen", "rejected"):
        ids, mask = r[f"{side}_ids"], r[f"{side}_mask"]
        assert len(ids) == len(mask) and t.decode(list(ids), skip_special_tokens=False) == r[f"{side}_text"]
        trained = t.decode([i for i, m in zip(ids, mask, strict=True) if m], skip_special_tokens=False)
        assert trained == r[f"{side}_text"].rpartition("<|assistant|>\n")[2]
    equal = got[4]
    assert equal["common_turns"] == 1 and equal["chosen_text"] == equal["rejected_text"] == "" and list(equal["chosen_ids"]) == []
    assert preference.format_pairs(pairs.limit(0)).count() == 0


def test_prefix_by_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [x for k in range(40) for x in turns(k, "open", *(str(v) for v in r.integers(0, 2, 4)))]
    c = preference.assembled(spark.createDataFrame(rows, TURNS))
    said = {x["conv"]: [tuple(t) for t in x["turns"]] for x in c.collect()}
    done = preference.format_pairs(preference.opening_pairs(c)).collect()
    assert len(done) == 39
    for x in done:
        a, b = said[x["chosen_id"]], said[x["rejected_id"]]
        n = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        assert x["common_turns"] == n


def test_openings_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 4)
    monkeypatch.setattr(preference, "SALT_ROWS", 8)
    r = np.random.default_rng(2)
    rows = [x for k in range(90) for x in turns(k, "open" if k % 3 else f"o{k % 4}", "y" * int(r.integers(0, 9)), "z", *["y"] * (k % 2))]
    rows += turns(200, "once", "y")
    c = common.cut(preference.assembled(spark.createDataFrame(rows, TURNS)), "c")
    said = {x["conv"]: [tuple(t) for t in x["turns"]] for x in c.collect()}
    length = lambda k: sum(len(t) for role, t in said[k] if role == "assistant")
    want = []
    for first in {t[0] for t in said.values()}:
        own = [k for k, t in said.items() if t[0] == first]
        top = min(own, key=lambda k: (-length(k), k))
        want += [(top, k) for k in own if k != top]
    pairs = preference.opening_pairs(c).collect()
    assert sorted((p["chosen_id"], p["rejected_id"]) for p in pairs) == sorted(want)
    assert all([tuple(t) for t in p["chosen"]] == said[p["chosen_id"]] and [tuple(t) for t in p["rejected"]] == said[p["rejected_id"]] for p in pairs)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>t</title><body><p>Whole page text", "Whole page text"),
        ('<head><meta name="a"><title>t</title><p>Whole</p><svg width="1"/><p>rest', "Whole\nrest"),
        ("<head><noscript><div>n</div></noscript><title>t</title></head>a<noscript>b</noscript>c", "a c"),
        ("<head><title>t</title>bare text", "bare text"),
        ("<p>a</p><svg><text>s</text></svg><template>x</template>b<svg>c<template>d<noscript>e", "a\nbcde"),
        ("<p>a</p><script>b<p>c", "a"), ("a<!-- b <p>c", "a"), ("<header>h</header>a", "h\na"),
    ],
)
def test_unclosed_tags_keep_the_page(page, text):
    assert warc.plain_text(page) == text
