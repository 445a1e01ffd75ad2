import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, language, toxicity

DOCS = "doc_id long, text string, lang string"
EN, FR = "the cat and the dog that were here with them", "le chat et le chien qui sont là avec eux pour être"


def corpus(spark):
    rows = [(n, (EN if n % 2 else FR) + f" {n}", "en" if n % 2 else "fr") for n in range(40)]
    return spark.createDataFrame(rows, DOCS)


def test_crc_rule(spark):
    ids = [*range(50), -3, 10**15]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", common.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_predictions_and_edges(spark):
    model = language.train(corpus(spark))
    rows = [(1, EN, "x"), (1, EN, "x"), (2, FR, None), (3, None, None), (4, "", None), (5, "12 !? 3", None), (None, "the dog", None), (6, FR * 20_000, None), (7, "the cat \U0001f600 ퟿", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit(1))
    got = language.identify(df, model).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "en"), (1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "fr"), (7, "en")]
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert language.identify(df.limit(0), model).count() == 0
    kept = language.keep_identified(spark.createDataFrame(rows, DOCS), model)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 2, 6, 7] and kept.columns == ["doc_id", "text", "lang"]


def test_letters_alone_count(spark):
    model = language.train(corpus(spark))
    rows = [(k, t, None) for k, t in enumerate(["½ ² ③ Ⅷ", "٣ 12", "_ \u0301", "ª", "日", "½a"])]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, DOCS), model).collect()}
    assert [got[k] == "und" for k in range(6)] == [not any(c.isalpha() for c in t) for _, t, _ in rows] == [True] * 3 + [False] * 3
    for text in ("a½b", "x²", "Ⅷ z", "a1b_c d", "é日ª٣"):
        assert language.normalized(text).split() == "".join(c if c.isalpha() else " " for c in text.lower()).split()


def test_no_labels(spark):
    model = language.train(spark.createDataFrame([], DOCS))
    assert [tuple(r) for r in language.identify(corpus(spark).limit(1), model).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_slices_change_nothing(spark, monkeypatch):
    model = language.train(corpus(spark))
    texts = [language.normalized(EN * k) for k in (1, 3, 40)]
    whole = model.log_joint(texts)
    monkeypatch.setattr(language, "_SLICE", 64)
    assert np.allclose(model.log_joint(texts), whole)


def test_sparse_product_by_brute_force(spark):
    model = language.train(corpus(spark), orders=(1, 2), bits=10)
    text = language.normalized("The cat là")
    want = model.log_prior.copy()
    for n in (1, 2):
        for at in range(len(text) - n + 1):
            h = n
            for c in text[at : at + n]:
                h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
            want += model.log_prob[h * 0x9E3779B97F4A7C15 % (1 << 64) >> 54]
    assert np.allclose(model.log_joint([text])[0], want)


def test_predictions_let_go_what_other_operators_remember():
    common.held("tokenizer", lambda: "words")
    language.LanguageModel((), np.zeros(0), np.zeros((5, 0)), (1,), 2).predict(["a"])
    assert "tokenizer" not in common._HELD


def test_held_out_accuracy(spark):
    from conftest import SMALL

    got = language.op7_language_id(spark, SMALL).join(common.read(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.95


BAD = "you are a vile toad today"


def toxic_corpus(spark, n=240):
    rows = [(i, f"{EN} {EN} " + (BAD if i % 4 == 0 else "nice day") + f" w{i % 17}", "en") for i in range(n)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    net = toxicity.train(docs, labels, language.train(docs))
    rows = [(1, "such a vile toad", None), (2, "such a nice day", None), (3, None, None), (4, "", None), (None, EN, None), (5, f"{EN} " * 15_000 + BAD, None)]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")), net).collect()}
    assert got[1]["predicted"] == 1 == got[5]["predicted"] and got[2]["predicted"] == 0 == got[4]["predicted"] and len(got) == 6
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[3]["score"] == got[4]["score"]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_no_training(spark, labels):
    docs, _ = toxic_corpus(spark, 8)
    net = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), language.train(docs))
    assert net is None and toxicity.score(docs, net).filter("score = 0 and predicted = 0").count() == 8


def test_pooling_by_brute_force(monkeypatch):
    net = toxicity.Network.new()
    for b in net.bias:
        b += 0.1
    texts = ["a b c d e f", "", "one", "two words", "x " * 50]

    def brute(text):
        x = np.array([net.embedding[list(toxicity.buckets(w))].sum(axis=0) for w in toxicity.tokens(text)])
        out = []
        for taps, bias in zip(net.taps, net.bias, strict=True):
            v = [sum(x[i + k] @ taps[k] for k in range(len(taps))) + bias for i in range(len(x) - len(taps) + 1)]
            out.append(np.maximum(np.max(v, axis=0), 0) if v else np.zeros(toxicity.FILTERS))
        return np.concatenate(out)

    want = np.array([brute(t) for t in texts])
    assert np.allclose(net.features(texts), want, atol=1e-4)
    monkeypatch.setattr(toxicity, "_SLICE", 7)
    assert np.allclose(net.features(texts), want, atol=1e-4)


def test_gradients_by_differences():
    r = np.random.default_rng(4)
    net = toxicity.Network.new()
    net.taps, net.bias = ([x + r.normal(scale=0.3, size=x.shape) for x in own] for own in (net.taps, net.bias))
    net.out, net.embedding = net.out + r.normal(scale=0.3, size=net.out.shape), net.embedding.astype(np.float64)
    dense = [*net.taps, *net.bias, net.out]
    own = np.array([toxicity.buckets(w) for w in toxicity.tokens("one two three four two one")], np.int32)

    def loss(label):
        grads = [np.zeros(x.shape) for x in dense]
        g, _, _ = toxicity.backward(net, own, label, 1.0, grads)
        p = g + label
        return -(label * np.log(p) + (1 - label) * np.log(1 - p))

    for label in (0.0, 1.0):
        grads = [np.zeros(x.shape) for x in dense]
        g, touched, values = toxicity.backward(net, own, label, 1.0, grads)
        total = np.zeros_like(net.embedding)
        np.add.at(total, np.concatenate(touched).ravel(), np.concatenate(values).reshape(-1, total.shape[1]))
        for x, grad in [*zip(dense, grads, strict=True), (net.embedding, total)]:
            some = np.argsort(-np.abs(grad), axis=None)[:6]
            for at in zip(*np.unravel_index(some, x.shape), strict=True):
                held, step, seen = x[at], 1e-6, []
                for way in (step, -step):
                    x[at] = held + way
                    seen.append(loss(label))
                x[at] = held
                assert abs((seen[0] - seen[1]) / (2 * step) - grad[at]) < 1e-4 * np.abs(grad).max() + 1e-6
        net.out_bias += 1e-4
        up = loss(label)
        net.out_bias -= 2e-4
        assert abs((up - loss(label)) / 2e-4 - g) < 1e-2
        net.out_bias += 1e-4


def test_thresholds_by_brute_force():
    r = np.random.default_rng(2)
    for _ in range(40):
        y = r.integers(0, 2, 30)
        y[:2] = 0, 1
        p = np.round(np.clip(0.3 * y + r.uniform(0, 0.7, 30), 0, 1), 2)
        f1 = lambda t: 2 * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + y.sum())
        best = max(f1(t) for t in (*p, *(p + 1e-9)))
        assert f1(toxicity.threshold(p, y)) >= 0.99 * best - 1e-9


def test_held_out_toxicity(spark):
    """Of documents that the training never saw: toxic ones score above the others, and most are told apart."""
    folder = "/root/testdata/sf0.1"
    docs = common.read(spark, folder, "documents").select("doc_id", "text", "lang").filter("doc_id < 5000")
    labels = common.read(spark, folder, "labels").select("doc_id", "toxic")
    seen = docs.filter(~common.held_out(F.col("doc_id")))
    net = toxicity.train(seen, labels.join(seen.select("doc_id"), "doc_id"), language.train(seen, sample_per_language=300), sample=600)
    rows = toxicity.score(docs.filter(common.held_out(F.col("doc_id"))), net).join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    toxic, rest = rows[rows.toxic == 1], rows[rows.toxic == 0]
    above = np.mean(toxic["score"].to_numpy()[:, None] > rest["score"].to_numpy()[None])
    assert len(toxic) > 30 and above > 0.9 and toxic["predicted"].mean() > 0.65 and rest["predicted"].mean() < 0.05


def test_threshold_parts_the_kinds():
    assert 0.3 < toxicity.threshold(np.array([0.1, 0.3, 0.8, 0.9]), np.array([0, 0, 1, 1])) < 0.8


def test_all_labelled_texts_are_learnt(spark):
    docs, labels = toxic_corpus(spark)
    n = {y: labels.filter(F.col("toxic") == y).count() for y in (0, 1)}
    kept = [common.sampled(labels.filter(F.col("toxic") == y), F.col("doc_id"), n[y], 20, 3).select("doc_id").collect() for y in (0, 1)]
    some = {r["doc_id"] for rows in kept for r in rows}
    assert 10 < len(some) < 100
    # A word of all toxic texts but those that training starts from.
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(*some) | (F.col("doc_id") % 4 != 0), F.col("text")).otherwise(F.regexp_replace("text", "vile toad", "gruzzle zorgle")))
    net = toxicity.train(docs, labels, language.train(docs, sample_per_language=None), sample=20)
    at, fresh = list(toxicity.buckets(b"gruzzle")), toxicity.Network.new().embedding
    assert (net.embedding[at] != fresh[at]).any()
    seen = toxicity.counted(docs.join(labels, "doc_id").selectExpr("doc_id k", "text t", "toxic y"), net, False)
    assert seen["n"].sum() == 240 and seen["hits"].sum() == 60


def test_thresholds_of_counts():
    r = np.random.default_rng(3)
    for _ in range(20):
        p, y = np.round(r.uniform(size=60), 1), r.integers(0, 2, 60)
        u, at = np.unique(p, return_inverse=True)
        assert toxicity.threshold(u, np.bincount(at, y), np.bincount(at)) == pytest.approx(toxicity.threshold(p, y))


def test_languages_count_all_texts(spark):
    whole, part = language.train(corpus(spark), sample_per_language=None), language.train(corpus(spark), sample_per_language=5)
    assert np.array_equal(whole.log_prob, language.train(corpus(spark)).log_prob) and not np.array_equal(whole.log_prob, part.log_prob)


def test_letters_of_many_texts():
    """Texts are normalized together as each is by itself, and a letterless one has two spaces."""
    texts = [None, "", "½", "12 !?", "a", " The  cat-là_x² ", "ΣΑΣ İ", "\ud800a", "é日ª٣", "😀𝒜", "x" * 50 + "."]
    want = [f" {' '.join(''.join(c if c.isalpha() else ' ' for c in (t or '').lower()).split())} " for t in texts]
    code, starts = language.letters(texts)
    assert ["".join(map(chr, code[a:b])) for a, b in zip(starts, starts[1:])] == want == [language.normalized(t) for t in texts]
    index = language.ngram_buckets(code, starts[1:], (1, 3), 12)
    for n, row in zip((1, 3), index, strict=True):
        assert [(row[a:b] < 1 << 12).sum() for a, b in zip(starts, starts[1:])] == [max(0, len(t) - n + 1) for t in want]


def test_runs_of_lists():
    for lengths in ([], [0, 0], [3, 9, 0, 1, 1, 40, 2], [5] * 20):
        got = list(common.runs(lengths, 8))
        assert [k for s in got for k in range(len(lengths))[s]] == list(range(len(lengths)))
        assert all(sum(lengths[s]) <= 8 + lengths[s][0] for s in got)


def test_gradients_of_a_batch():
    """A batch's gradients are the sums of its texts', also of texts shorter than a filter."""
    r = np.random.default_rng(9)
    net = toxicity.Network.new()
    net.bias = [b + np.float32(0.05) for b in net.bias]
    texts = ["", "a", "b a", "a b a c d e a", *(" ".join(r.choice(list("abcdefgh"), 30)) for _ in range(5))]
    ids, table = toxicity.numbered(texts)
    labels, weights = r.integers(0, 2, len(texts)).astype(float), r.random(len(texts))
    dense = [*net.taps, *net.bias, net.out]

    def plain():
        grads, total, bias = [np.zeros(x.shape) for x in dense], np.zeros(net.embedding.shape), 0.0
        for own, label, weight in zip(ids, labels, weights, strict=True):
            x, peaks, z = np.array([net.embedding[table[w]].sum(axis=0) for w in own]), [], net.out_bias
            for k, taps in enumerate(net.taps):
                for f in range(toxicity.FILTERS):
                    v = [sum(x[i + j] @ taps[j][:, f] for j in range(len(taps))) + net.bias[k][f] for i in range(len(x) - len(taps) + 1)]
                    if v and max(v) > 0:
                        peaks.append((k, f, int(np.argmax(v)), max(v)))
                        z += max(v) * net.out[k * toxicity.FILTERS + f]
            g = (1 / (1 + np.exp(-z)) - label) * weight
            bias += g
            for k, f, i, v in peaks:
                back = g * net.out[k * toxicity.FILTERS + f]
                grads[-1][k * toxicity.FILTERS + f] += g * v
                grads[len(net.taps) + k][f] += back
                for j in range(len(net.taps[k])):
                    grads[k][j][:, f] += back * x[i + j]
                    np.add.at(total, table[own[i + j]], back * net.taps[k][j][:, f])
        return grads, total, bias

    grads, total = [np.zeros(x.shape) for x in dense], np.zeros(net.embedding.shape)
    g, touched, values = toxicity.gradients(net, ids, table, labels, weights, grads)
    np.add.at(total, touched.ravel(), values.reshape(-1, toxicity.DIMENSIONS))
    for got, want in zip((*grads, total, g.sum()), (lambda a, b, c: (*a, b, c))(*plain()), strict=True):
        assert np.allclose(got, want, atol=1e-6)


def test_each_word_is_embedded_once(monkeypatch):
    """The work of training and scoring goes with a batch's different words, not with all of them."""
    seen, plain = [], toxicity.summed
    monkeypatch.setattr(toxicity, "summed", lambda e, rows: seen.append(len(rows)) or plain(e, rows))
    texts, y = ["one two three " * 500, "two four " * 500], np.array([0, 1])
    descent = toxicity.Descent(toxicity.Network.new())
    descent.epoch(*toxicity.numbered(texts), y, np.ones(2))
    assert 0 < sum(seen) <= 5
    seen.clear()
    assert np.isfinite(descent.net.raw(texts)).all() and sum(seen) == 4
