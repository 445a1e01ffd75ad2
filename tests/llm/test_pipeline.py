import os
import uuid

import corpus_pipeline
import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from lectern.llm import common, language

from .test_formats import check_packing
from .test_matching import brute_dedup, brute_force, brute_runs, said


def test_each_stage_on_its_own_input(spark):
    docs = common.read(spark, SMALL, "documents")
    junk = spark.createDataFrame([(10**6, "12 34 !!", "en", "s", 8), (10**6 + 1, None, None, None, None)], docs.schema)
    docs, columns, counts = docs.unionByName(junk), docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SMALL), name)
        counts.append(docs.count())
        assert docs.columns == columns
    assert counts[0] <= 200 and counts == sorted(counts, reverse=True) and counts[-1] > 100
    assert docs.filter("n_chars != length(text)").count() == 0
    packed = corpus_pipeline.pack(spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_clean_documents_stay(spark):
    rows = [(k, f"Words of their own number {k} stand in this text. It goes on with {k * 7} more of them, then ends at {k * 31}.", "en", "s", 0) for k in range(60)]
    docs = spark.createDataFrame(rows, common.read(spark, SMALL, "documents").schema).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 60


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100


def plain_languages(docs, orders=(1, 2, 3), smoothing=0.1):
    """Naive Bayes over the same hashed n-grams, by dictionaries: (language, posterior) of each text with letters."""
    clean = lambda t: f" {' '.join(''.join(c if c.isalpha() else ' ' for c in (t or '').lower()).split())} "

    def grams(t):
        for n in orders:
            for at in range(len(t) - n + 1):
                h = n
                for c in t[at : at + n]:
                    h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
                yield h * 0x9E3779B97F4A7C15 % (1 << 64) >> 48

    counts, prior = {}, {}
    for _, text, lang, *_ in docs:
        if text is not None and lang is not None:
            prior[lang] = prior.get(lang, 0) + 1
            own = counts.setdefault(lang, np.full(1 << 16, smoothing))
            for g in grams(clean(text)):
                own[g] += 1
    out = {}
    for k, text, *_ in docs:
        if any(c.isalpha() for c in text or ""):
            joint = {x: np.log(n / sum(prior.values())) + sum(np.log(counts[x][g] / counts[x].sum()) for g in grams(clean(text))) for x, n in prior.items()}
            top = max(joint.values())
            out[k] = (max(joint, key=joint.get), 1 / sum(np.exp(v - top) for v in joint.values()))
    return out


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage on its own input, against a plain version of its rule written apart from the operators."""
    passage, item = " ".join(said(9, 50 + k).capitalize() + "." for k in range(12)), said(40, 888)
    said_in = lambda k, n: said(n, k) if k % 2 else said(n, k).replace("a", "ü").replace("o", "eau")
    docs = [(k, f"{said_in(k, 60)}. {said_in(100 + k, 50)}", "en" if k % 2 else "fr") for k in range(24)]
    docs += [(30 + k, f"{said_in(31 + 2 * k, 30)}\n{passage}\n{said_in(131 + 2 * k, 25)}", "en") for k in range(4)]
    docs += [(40 + k, docs[1][1].replace("alpha", f"w{k}", 1) + " tail" * k, "en") for k in range(3)] + [(45, docs[3][1], "en"), (46, said_in(71, 30) + " " + item + " " + said_in(73, 30), "en")]
    docs += [(50, "12 ½ ²", "en"), (51, None, "en"), (52, "", None), (53, item, "en"), (54, said_in(75, 3), None)]
    rows = [(k, t, lang, "s", len(t or "")) for k, t, lang in docs]
    df = spark.createDataFrame(rows, common.read(spark, SMALL, "documents").schema)
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = lambda frame: {r["doc_id"]: r["text"] for r in frame.collect()}

    said_to_be = plain_languages(rows)
    kept = corpus_pipeline.identify_language(spark, df, str(tmp_path))
    model = language.identify(df, language.train(df)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in model if r["lang_pred"] != "und"} == {k: x for k, (x, _) in said_to_be.items()}
    assert set(texts(kept)) == {k for k, (_, p) in said_to_be.items() if p >= 0.5} and not {50, 51, 52} & set(texts(kept))

    kept = common.cut(kept, "kept")
    lined = common.cut(corpus_pipeline.dedup_lines(spark, kept, str(tmp_path)), "lined")
    after_chunks = brute_dedup(sorted(texts(kept).items()))
    want = brute_runs(sorted(after_chunks.items()))
    want = {k: w for k, w in want.items() if w or after_chunks[k] == texts(kept)[k]}
    assert {k: common.words(t) for k, t in texts(lined).items()} == want
    unique = lambda d: {w for t in d.values() for w in common.words(t)}
    assert unique(texts(lined)) == unique(texts(kept))

    for source in (lined, kept):  # near copies are many where no lines were taken out
        one = common.cut(corpus_pipeline.drop_near_duplicates(spark, source, str(tmp_path)), "one")
        classes = brute_force(list(texts(source).items()))
        assert set(texts(one)) == {k for k, (c, _) in classes.items() if c == k}

    clean = corpus_pipeline.decontaminate(spark, one, str(tmp_path))
    words, dirty = [w.decode() for w in common.words(item)], set()
    windows = {tuple(words[i : i + 13]) for i in range(len(words) - 12)}
    for k, t in texts(one).items():
        own = [w.decode() for w in common.words(t)]
        hit = {j for i in range(len(own) - 12) if tuple(own[i : i + 13]) in windows for j in range(i, i + 13)}
        dirty |= {k} if hit and 20 * len(hit) >= len(own) else set()
    assert dirty == {46, 53} and set(texts(clean)) == set(texts(one)) - dirty
    check_packing(corpus_pipeline.pack(spark, clean, str(tmp_path)).collect(), list(texts(clean).items()), 2048)


def test_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    n = corpus_pipeline.run(spark, SMALL).count()
    left = sorted(x.rpartition("-")[0] for x in os.listdir(tmp_path))
    assert n > 100 and left == ["decontamination", "pieces"]
