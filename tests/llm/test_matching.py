import hashlib

import duckdb
import numpy as np
import pytest
from conftest import SMALL, same
from pyspark.sql import functions as F

from lectern.llm import common, contamination, jaccard_join, line_dedup, neighbours, queries

DOCS = "doc_id long, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def said(n, seed=0):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, tmp_path, name):
    assert same(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLE_SQL[name], tmp_path) > 0


def test_words_agree(spark):
    texts = ["A-b C1_d é É 日本 ǅ!", "", None, "x\ty z", "İstanbul"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(common.words_column(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if t is None else [w.decode() for w in common.words(t)] for t in texts]


def against_sql(spark, docs, items, tmp_path, **options):
    d = spark.createDataFrame(docs, DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    return same(contamination.judge(d, b, **options), con, contamination.OP3_SQL, tmp_path)


CASES = [(1, said(40, 1)), (2, "x " + said(40, 1)[30:] + " y"), (3, None), (4, ""), (5, "Alpha, BETA"), (6, "alpha gamma beta"), (7, said(14, 3) * 3), (8, said(40, 1)), (9, said(3000, 9) + " " + said(20, 1))]
ITEMS = [(1, said(40, 1)), (2, "alpha beta"), (3, ""), (4, None), (None, "gamma"), (10, said(14, 3)), (2, "beta nosuch")]


def test_contamination(spark, tmp_path):
    assert against_sql(spark, CASES, ITEMS, tmp_path) == len(CASES)


def test_contamination_in_blocks(spark, tmp_path):
    assert against_sql(spark, CASES, ITEMS, tmp_path, block_bytes=1) == len(CASES)


def test_contamination_in_small_segments(spark, tmp_path):
    assert against_sql(spark, CASES, ITEMS, tmp_path, segment_words=10) == len(CASES)


def test_contamination_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (1, "gamma"), (None, "beta"), (None, "alpha beta"), (2**53 + 1, None)], DOCS).withColumn("n_hit", F.lit("old")).withColumn("k", F.lit(1))
    items = spark.createDataFrame([(7, "ALPHA beta")], "item_id long, text string").withColumn("i", F.lit(2)).withColumn("t", F.lit("x"))
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in contamination.judge(docs, items).collect())
    assert got == [(0, 1, 0, 0), (0, 2, 2, 1), (1, 1, 0, 0), (1, 2, 2, 1), (1, 2, 2, 1), (2**53 + 1, 0, 0, 0)]
    clean = contamination.keep_clean(docs, items)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in clean.collect()) == [(0, "beta"), (1, "gamma"), (2**53 + 1, "")] and clean.columns == docs.columns
    assert contamination.keep_clean(docs, items, broadcast_bytes=0).count() == 3
    none = contamination.judge(docs, spark.createDataFrame([], "item_id long, text string")).first()
    assert (none["n_items"], none["items_sha256"], none["contaminated"]) == (0, hashlib.sha256(b"").hexdigest(), False)
    assert contamination.judge(docs.limit(0), spark.createDataFrame([(7, "a")], "item_id long, text string")).count() == 0


def test_a_benchmark_of_many_windows(spark, tmp_path):
    """Items with 60,000 windows of few different words, so that nearly all have postings everywhere."""
    items = [(k, said(600, 3000 + k)) for k in range(100)]
    docs = [(k, said(300, k) + " " + " ".join(items[k][1].split()[k : k + 12 + k % 4]) + " " + said(200, 900 + k)) for k in range(60)]
    assert against_sql(spark, docs, items, tmp_path, block_bytes=100_000) == len(docs)


def test_an_index_is_asked_many_times(spark):
    docs = spark.createDataFrame([(1, "a b c a x b a b"), (2, "b a"), (3, None), (4, "é日 a b")], DOCS)
    index = contamination.stored(docs, limit=5)
    assert index.count() > 1
    for text, want in (("a b", [(1, 0), (1, 6), (4, 1)]), ("A B a", []), ("b", [(1, 1), (1, 5), (1, 7), (2, 0), (4, 2)]), ("é日 a", [(4, 0)])):
        ask = spark.createDataFrame([(1, text), (2, "zz"), (3, text.replace("a", "A"))], "item_id long, text string")
        got = sorted((r["doc_id"], r["position"]) for r in contamination.matches(index, ask).filter("item = 1").collect())
        assert got == want and contamination.matches(index, ask).count() == 2 * len(want)


def brute_near(words, asked, span):
    """Starts from which the asked words follow in order, each at its first place after the one before."""
    out = []
    for start in (i for i, w in enumerate(words) if w == asked[0]):
        at = start
        for w in asked[1:]:
            at = next((i for i in range(at + 1, len(words)) if words[i] == w), None)
            if at is None:
                break
        if at is not None and at - start < span:
            out.append(start)
    return out


def test_phrase_and_proximity_matches(spark):
    docs = [(k, said(60, k)) for k in range(20)] + [(20, None), (21, "")]
    asked = [(k, said(2 + k % 2, 700 + k)) for k in range(30)] + [(40, " ".join(docs[3][1].split()[5:25]))]
    index = contamination.stored(spark.createDataFrame(docs, DOCS), limit=200)
    ask = spark.createDataFrame(asked, "item_id long, text string")
    words = {k: (t or "").split() for k, t in docs}
    exact = sorted((r["doc_id"], int(r["item"]), r["position"]) for r in contamination.matches(index, ask).collect())
    assert exact == sorted((d, k, i) for d, w in words.items() for k, t in asked for i in range(len(w)) if w[i : i + len(t.split())] == t.split()) != []
    near = sorted((r["doc_id"], int(r["item"]), r["position"]) for r in contamination.matches(index, ask, span=25).collect())
    assert near == sorted((d, k, i) for d, w in words.items() for k, t in asked for i in brute_near(w, t.split(), 25)) != []
    assert contamination.matches(index, ask.limit(0)).count() == 0


def test_batches_of_few_bytes_change_nothing(spark):
    docs = spark.createDataFrame(CASES, DOCS).coalesce(1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    run = lambda: [sorted(map(str, df.collect())) for df in (contamination.judge(docs, items), line_dedup.dedup(docs), contamination.keep_clean(docs, items))]
    common.bounded_batches(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, whole = spark.conf.get(name), run()
    assert int(before.rstrip("b")) <= common.BATCH_BYTES
    try:
        spark.conf.set(name, "2000")
        assert run() == whole and spark.conf.get(name).rstrip("b") == "2000"
    finally:
        spark.conf.set(name, before)


# Jaccard join


def brute_force(docs, n=5, t=0.8):
    sets = {}
    for k, text in docs:
        w = common.words(text)
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    ids, root = sorted(sets), {k: k for k in sets}
    links = dict.fromkeys(ids, 0)
    find = lambda x: x if root[x] == x else find(root[x])
    text = dict(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            like = bool(x and y) and len(x & y) >= t * len(x | y) - 1e-9
            if like:
                links[a] += 1
                links[b] += 1
            if like or text[a] == text[b]:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (find(k), links[k]) for k in ids}


def variants(base, n, seed):
    r, out = np.random.default_rng(seed), []
    for k in range(n):
        w = base.split()
        for at in r.integers(0, len(w), k % 6):
            w[at] = f"w{r.integers(1000)}"
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(spark, monkeypatch):
    texts = variants(said(120, 4), 40, 1) + variants(said(60, 5), 25, 2) + [said(50, 100 + k) for k in range(20)]
    texts += ["", "", None, None, "a b", "a b", "A, b!", "one two three four five", texts[0], texts[0] + " tail"]
    docs = list(enumerate(texts))
    want = brute_force(docs)
    for block in (jaccard_join.BLOCK, 8):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.similar(spark.createDataFrame(docs, DOCS)).collect()}
        assert got == want


def test_join_edges(spark):
    df = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "x y z"), (2, "x y z"), (3, "q")], DOCS).withColumn("digest", F.lit(1)).withColumn("class_id", F.lit("old"))
    got = sorted(tuple(r) for r in jaccard_join.similar(df).collect())
    assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 3, 0)]
    left = jaccard_join.one_of_each(df)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 3] and left.columns == df.columns
    assert jaccard_join.similar(df.limit(0)).count() == 0


def test_texts_of_one_id_are_judged_each(spark):
    a, b = said(80, 1), said(80, 2)
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (7, f"{b} end"), (6, None), (6, None), (8, None)]
    left = jaccard_join.one_of_each(spark.createDataFrame(rows, DOCS))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [(1, a), (5, b), (None, a), (6, None)]))


def test_values_of_long_texts_differ():
    r = np.random.default_rng(8)
    x, y = (jaccard_join.minhash(r.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2)) for _ in "ab")
    many = [jaccard_join.minhash(r.integers(0, 1 << 63, 20_000).astype(np.uint64)) for _ in range(12)]
    agree = [np.mean(a == b) for k, a in enumerate(many) for b in many[:k]]
    assert np.mean(x == y) < 0.01 and np.mean(agree) < 0.001
    assert all(len(np.unique(np.concatenate([a, b]))) > 300 for a, b in zip(many, many[1:], strict=False))


def test_long_texts_join_as_by_brute_force(spark):
    docs = [(k, said(20_000, 40 + k)) for k in range(4)]
    docs += [(10 + k, t) for k, t in enumerate(variants(docs[0][1], 3, 5) + [docs[1][1] + " " + said(3000, 77), docs[2][1] + " " + said(6000, 78)])]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.similar(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute_force(docs)


def test_hot_keys_are_joined_apart(spark):
    rows = spark.createDataFrame([(k if k % 3 else 0, k) for k in range(3000)], "a long, x long")
    one = spark.createDataFrame([(k, -k) for k in range(2000)], "a long, y long")
    hot = common.hot_keys(rows, "a")
    assert [r[0] for r in hot.collect()] == [0] == [r[0] for r in common.hot_keys(rows, "a", rows.groupBy("a").agg(F.count("*").alias("n"))).collect()]
    assert sorted(map(tuple, common.hot_join(rows, one, "a", hot).collect())) == sorted(map(tuple, rows.join(one, "a").collect()))


def test_a_giant_class(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    texts = variants(said(60, 5), 60, 3) + [said(60, 5)] * 30 + [said(40, 300 + k) for k in range(20)]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.similar(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute_force(docs)


def test_pruning_keeps_similar_pairs():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 62, 400).astype(np.uint64)
    a = jaccard_join.minhash(base)[None]
    kept = {}
    for share in (0.2, 0.95):
        others = []
        for _ in range(60):
            x = base.copy()
            n = int(400 * (1 - share) / (1 + share))
            x[:n] = r.integers(0, 1 << 62, n)
            others.append(jaccard_join.minhash(x))
        kept[share] = len(jaccard_join.surviving(a, np.array(others), np.zeros(60, int), np.arange(60), 0.8, 1e-4))
    assert kept == {0.2: 0, 0.95: 60}


def test_many_overlaps_are_counted():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, 120).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert jaccard_join.overlaps(sets, i, j).tolist() == want == np.concatenate([jaccard_join.overlaps(sets, i[k : k + 9], j[k : k + 9]) for k in range(0, len(i), 9)]).tolist()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a int, b int")
    got = {r["node"]: r["root"] for r in jaccard_join.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# Line dedup


def mixed(x):
    m = (1 << 64) - 1
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & m
    return x ^ x >> 33


def plain_lines(text):
    """(first, last) character of each line, by reading one character after the other."""
    out, line = [], None
    for at, c in enumerate(text):
        if c in "\n.,;:!?。、．，；：！？؟،؛।॥":
            out += [line] if line else []
            line = None
        elif c not in " \t\r\v\f":
            line = (line[0] if line else at, at + 1)
    return out + ([line] if line else [])


def plain_chunks(text, least=40, long=250, longest=64):
    """(first, last) character of each chunk, by the rule in words: a chunk ends where the hash of two lines is least."""
    power, own, values = 0x9E3779B97F4A7C15, plain_lines(text), []
    for n, (a, b) in enumerate(own):
        raw = text[a:b].encode()
        h = mixed((sum((c + 1) * pow(power, i, 1 << 64) for i, c in enumerate(raw)) + len(raw)) % (1 << 64))
        values.append((h, mixed((h + (values[n - 1][0] * power if n else 0)) % (1 << 64))))
    spans, begin = set(), 0
    for n in range(len(own)):
        v = [x[1] for x in values]
        least_here = 1 <= n < len(own) - 1 and v[n] < v[n - 1] and v[n] <= v[n + 1]
        if least_here or n == len(own) - 1 or n + 1 - begin == longest:
            spans.add((begin, n + 1))
            begin = n + 1
    spans = {(a, b) for a, b in spans if b - a > 1 and own[b - 1][1] - own[a][0] >= least}
    spans |= {(n, n + 1) for n, (a, b) in enumerate(own) if b - a >= long}
    spans |= {(a, b) for a, b in spans if own[b - 1][1] - own[a][0] >= long}
    return [(own[a][0], own[b][0] if b < len(own) else len(text)) for a, b in sorted(spans)]


def brute_dedup(docs):
    """Chunk texts of all documents in order of id; a repeated one goes. No part of the operator is used."""
    seen, out = set(), {}
    for k, text in sorted((d for d in docs if d[0] is not None and d[1] is not None), key=lambda d: d[0]):
        gone = set()
        for first, last in plain_chunks(text):
            body = text[first:last].strip()
            gone |= set(range(first, last)) if body in seen else set()
            seen.add(body)
        out[k] = "".join(c for at, c in enumerate(text) if at not in gone)
    return out


def lines(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(" ".join(r.choice(WORDS, 6)).capitalize() + "." for _ in range(n))


def test_line_dedup_equals_brute_force(spark):
    passage = lines(14, 77)
    docs = [(k, f"{lines(3 + k % 5, k)}\n{passage}\n{lines(2, 500 + k)}" if k % 3 == 0 else lines(6, k)) for k in range(30)]
    docs += [(40, None), (41, ""), (42, docs[1][1]), (43, passage + "\n" + passage), (44, "word " * 3000), (45, "word " * 3000), (46, "a b! " * 200)]
    docs += [(47, "語" * 90 + "。" + "語文、" * 30), (48, "前 " + "語" * 90 + "。" + "語文、" * 30), (49, " ... \n\n"), (50, "é" * 260 + ". x"), (51, "y, " + "é" * 260)]
    df = spark.createDataFrame([*docs, (None, docs[1][1])], DOCS).withColumn("removed_chars", F.lit("old")).withColumn("body", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got.pop(None) == docs[1][1] and got.pop(40) is None
    want = brute_dedup(docs)
    assert {k: t for k, t in got.items() if t != want[k]} == {}
    assert sum(passage in (t or "") for t in got.values()) == 1 and got[1] == docs[1][1] and got[42] == "" == got[45]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_rows_and_clean_texts_stay(spark):
    df = spark.createDataFrame([(1, lines(9, 1)), (1, lines(9, 1)), (2, lines(9, 2))], DOCS)
    assert [r["removed_chunks"] for r in line_dedup.dedup_lines(df).collect()] == [0, 0, 0] == [r["removed_chunks"] for r in line_dedup.dedup(df).collect()]


def test_texts_of_one_id_lose_only_what_recurs(spark):
    a, b = lines(40, 1), lines(40, 2)
    rows = [(1, a), (5, a), (5, b), (7, said(90, 3)), (7, said(90, 4)), (8, said(90, 3)), (8, said(90, 5))]
    names = [f"c{n}" for n in range(2)] + ["k", "d", "t", "row", "numbers", "hashes", "new", "chunks"]
    df = spark.createDataFrame(rows, DOCS)
    for n in names:
        df = df.withColumn(n, F.lit(n))
    out = line_dedup.dedup(df)
    got = sorted((r["doc_id"], r["text"]) for r in out.collect())
    assert got == sorted([(1, a), (5, ""), (5, b), (7, said(90, 3)), (7, said(90, 4)), (8, ""), (8, said(90, 5))])
    assert out.columns == [*df.columns, "removed_chunks", "removed_chars"] and out.filter(" or ".join(f"{n} <> '{n}'" for n in names)).count() == 0


def test_every_word_keeps_a_copy(spark):
    docs = common.read(spark, SMALL, "documents")
    before = [common.words(r["text"]) for r in docs.collect()]
    after = [common.words(r["text"]) for r in line_dedup.dedup(docs).collect()]
    assert {w for t in before for w in t} == {w for t in after for w in t}
    assert sum(map(len, after)) < sum(map(len, before))
    runs = [tuple(w[i : i + 50]) for w in after for i in range(len(w) - 49)]
    assert len(runs) == len(set(runs))


def test_lines_are_between_marks():
    for text in ("a, b. c\n\nd", "", "...", "no end", " x;  y\n", "a.b.c", "\n\n", "語。文、é b! c", "x" * 300):
        c = line_dedup.Chunks(["q, r", text, "z"], 0, 1)
        one = [(int(c.first[k] - c.text_at[1]), c.body(k)) for k in np.flatnonzero(c.row == 1)]
        want = {(len(text[:a].encode()), text[a:b].encode()) for a, b in plain_lines(text)}
        assert want <= {(a, body.rstrip(".,;!。、".encode())) for a, body in one} or not want


def test_bytes_of_wide_marks_become_stops():
    r = np.random.default_rng(8)
    for n in range(200):
        raw = "".join(r.choice(list("ab .\n語é।॥。、！؟،؛\u0900\u3000"), n % 40)).encode() + (b"\xe3\x80", b"\xd8", b"")[n % 3]  # cut characters, too
        want = raw
        for m in line_dedup.WIDE_MARKS:
            want = want.replace(m.encode(), b"." * len(m.encode()))
        assert line_dedup._marked(raw).tobytes() == want


def test_texts_beside_each_other_have_the_chunks_and_runs_of_their_own():
    texts = ["", lines(9, 1), "", "", "語" * 300 + "。" + lines(5, 2), "é", said(70, 3), "", "..."]
    c, r = line_dedup.Chunks(texts, 20, 250), line_dedup.Runs(texts, 50)
    for k, text in enumerate(texts):
        own, at = line_dedup.Chunks([text], 20, 250), c.row == k
        assert c.number[at].tolist() == own.number.tolist() and c.hash[at].tolist() == own.hash.tolist()
        assert [c.body(x) for x in np.flatnonzero(at)] == [own.body(x) for x in range(len(own.row))]
        assert r.number[r.row == k].tolist() == list(range(len(common.words(text))))
        assert r.by_text()[k].tolist() == line_dedup.Runs([text], 50).by_text()[0].tolist()


def test_boundaries_shift_with_the_content():
    r = np.random.default_rng(5)
    h, extra = r.integers(0, 1 << 60, 200).astype(np.uint64), r.integers(0, 1 << 60, 3).astype(np.uint64)
    a, b = line_dedup.boundaries(h), line_dedup.boundaries(np.concatenate([extra, h]))
    assert set((a[3:] + 3).tolist()) <= set(b.tolist())
    assert np.diff(line_dedup.boundaries(np.zeros(300, np.uint64)), prepend=0).max() == 64


def test_the_rolling_hash_resists_shifts():
    """Lines put in front of a passage move none of its boundaries beyond its second line; a changed line moves those near it."""
    r = np.random.default_rng(6)
    h = r.integers(0, 1 << 62, 300).astype(np.uint64)
    cut = lambda x: line_dedup.boundaries(line_dedup.rolled(x, np.zeros(1, np.int64)))
    whole = set(cut(h).tolist())
    for n in (1, 2, 7):
        moved = {e - n for e in cut(np.concatenate([r.integers(0, 1 << 62, n).astype(np.uint64), h])).tolist()}
        assert {e for e in whole if e > 3} == {e for e in moved if e > 3}
    changed = h.copy()
    changed[150] += np.uint64(1)
    differ = whole ^ set(cut(changed).tolist())
    assert all(149 <= e <= 154 for e in differ) and 60 < len(whole) < 140


def brute_runs(docs, run=50):
    """Texts without words of runs that occur earlier."""
    seen, out = set(), {}
    for k, text in docs:
        words, gone = common.words(text), []
        for i in range(len(words) - run + 1):
            own = tuple(words[i : i + run])
            gone += range(i, i + run) if own in seen else ()
            seen.add(own)
        out[k] = [w for i, w in enumerate(words) if i not in set(gone)]
    return out


def test_no_run_of_50_words_recurs(spark):
    docs = [(k, f"{said(80, k)}\n\n{said(60, 900) if k % 2 else said(120, 901)}\n\n{said(70, 100 + k)}") for k in range(8)]
    docs += [(8, "é日 " + said(50, 900)), (9, said(49, 900)), (10, "a b c d e " * 11), (11, "word " * 4000), (12, said(90, 950) + " ü " + said(90, 950)), (13, ""), (14, None)]
    df = spark.createDataFrame([*docs, (None, docs[1][1])], DOCS)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_runs(df).collect()}
    assert got.pop(None) == docs[1][1] and got.pop(14) is None
    assert {k: common.words(t) for k, t in got.items()} == brute_runs(docs[:-1])
    assert got[2] == f"{said(80, 2)}\n\n{said(70, 102)}" and got[8] == "é日 "
    whole = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df.filter("doc_id < 14")).collect()}
    runs = [tuple(w[i : i + 50]) for w in map(common.words, whole.values()) for i in range(len(w) - 49)]
    assert len(runs) == len(set(runs)) > 500
    assert line_dedup.dedup_runs(df.limit(0)).count() == 0


def test_long_lines_are_chunks_anywhere():
    line = "語" * 300
    c = line_dedup.Chunks([f"a.\nb.\n{line}\nc.\nd."], 40, 250)
    assert line.encode() in [c.body(k) for k in range(len(c.row))]


# Neighbours

VECTORS = "vec_id long, embedding array<float>"


def brute_neighbours(rows, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % 50 == 0:
            near = sorted((-float(np.add.accumulate(x * y)[-1] / np.sqrt(np.add.accumulate(x * x)[-1] * np.add.accumulate(y * y)[-1])), i) for i, y in good if i != q and len(x) == len(y))[:k]
            out[q] = [i for _, i in near]
    return out


def found(df, **options):
    out = {}
    for r in neighbours.nearest(df, F.col("id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(2)
    near = r.normal(size=7)
    rows = [(i, (r.normal(size=7) if i % 3 else near + r.normal(scale=1e-3, size=7)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(450, None), (500, [0.0] * 7), (550, [float("nan")] + [1.0] * 6), (600, [None] + [1.0] * 6), (650, [1.0, 2.0]), (651, [2.0, 1.0]), (None, [1.0] * 7), (700, rows[3][1]), (701, rows[3][1])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("old")).withColumn("v", F.lit(0))
    want = brute_neighbours(rows)
    assert found(df) == want == found(df, segment_rows=64, block_queries=3, sample=50)
    assert found(df.limit(0)) == {}


def test_scan_is_the_coded_product():
    r = np.random.default_rng(4)
    x = neighbours._units(r.normal(size=(50, 9)))
    books = neighbours.fit_books(x)
    codes, parts = neighbours.encode(x, books)
    back = books[np.arange(5), codes].reshape(50, -1)
    got = neighbours.scan(x[:3], neighbours.packed(codes), books)
    assert np.allclose(got, neighbours._even(x[:3]) @ back.T, atol=1e-5)
    true = x[:3] @ x.T
    assert (np.abs(got - true) <= np.hypot(*parts) + 1e-5).all()
    for i in range(3):
        for s in (-0.5, 0.0, 0.3, 0.9, 1.0):
            reach = true[i] >= s
            assert (got[i][reach] >= neighbours.least_sums(s, parts)[reach] - 1e-5).all()


def test_codes_lower_the_whole_loss():
    r = np.random.default_rng(5)
    x = neighbours._units(r.normal(size=(600, 16)))
    books, plain = neighbours.fit_books(x), neighbours.fit_books(x, parallel=1.0)
    v = x.reshape(600, 8, 2)
    near = lambda b: np.stack([((v[:, p, None] - b[p]) ** 2).sum(axis=2).argmin(axis=1) for p in range(8)], axis=1)
    codes = neighbours._assigned(x, books, 4.0, sweeps=6)
    assert neighbours.loss(x, codes, books).mean() < min(neighbours.loss(x, near(books), books).mean(), neighbours.loss(x, near(plain), plain).mean())
    for p in range(8):  # no single code of a row could be better, given its others
        for k in range(16):
            other = codes.copy()
            other[:, p] = k
            assert (neighbours.loss(x, other, books) >= neighbours.loss(x, codes, books) - 1e-9).mean() > 0.98
    along = lambda c, b: np.abs((neighbours.residuals(x, c, b) * x).sum(axis=1)).mean()
    assert along(codes, books) < 0.6 * along(near(plain), plain)


def test_few_rows_are_scored_exactly():
    """On random directions, the hardest case, and on groups: the answers of brute force, and the share scored."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 32))
    for x, most in ((r.normal(size=(4000, 32)), 0.25), (centres[r.integers(0, 40, 4000)] + 0.15 * r.normal(size=(4000, 32)), 0.05)):
        u = neighbours._units(x)
        books = neighbours.fit_books(u[:1000])
        codes, parts = neighbours.encode(u, books)
        q = np.arange(0, 4000, 50)
        got, extra = neighbours.best(q, x[q], np.arange(4000), x, neighbours.packed(codes), parts, books, 5)
        score = u[q] @ u.T
        score[np.arange(len(q)), q] = -2
        want = np.argsort(-score, axis=1)[:, :5]
        assert (got["vec_id"].to_numpy().reshape(-1, 5) == want).all() and extra / (len(q) * 4000) < most
