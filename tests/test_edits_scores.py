import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lectern import catalogue
from lectern.functions import exact
from lectern.operators import score
from lectern.operators.edits import Edit, Policy, apply_edits, applied, issues, locate, splice

TEXT = "The mill burned (Ng 1999; Li 2001). Nobody came. The mill, he said, was old [4].\n\nThe end of it."


def one(original, replacement="", sentence=1, text=TEXT, **policy):
    return apply_edits(text, [Edit("c", original, replacement, "", sentence)], Policy(**policy))


def test_nothing_proposed_changes_nothing():
    assert apply_edits(TEXT, []) == (TEXT, [], [])


def test_deletions_tidy_spaces():
    text, done, warnings = apply_edits(TEXT, [Edit(original="(Ng 1999; Li 2001)", sentence=1), Edit(original="[4]", sentence=3)])
    assert text.startswith("The mill burned. Nobody came. The mill, he said, was old.\n\n") and len(done) == 2 and not warnings


def test_wrong_sentence_number_is_put_right():
    _, done, _ = one("Nobody", "No one", 1)
    assert done[0].sentence == 2


def test_refusals():
    for edit, words in (
        (Edit(original="not there", sentence=1), "nowhere in the passage"), (Edit(original="The mill", sentence=2), "more than one other sentence"),
        (Edit(original="e", sentence=1), "more than once"), (Edit(original="  ", sentence=1), "nothing is quoted"),
        (Edit(original="zzz", sentence=9), "there is no sentence 9"), (Edit(original="old [4].  The end", sentence=3), "paragraph break"),
        (Edit(original="Nobody", replacement="Seven quite new words are put here", sentence=2), "an adaptation may change in one edit"),
        (Edit(original="Nobody", replacement="In summary, none", sentence=2), "as a summary does"),
    ):
        text, done, warnings = apply_edits(TEXT, [edit])
        assert text == TEXT and not done and len(warnings) == 1 and words in warnings[0], words


def test_labels():
    text, done, warnings = apply_edits(TEXT, [Edit(original="2: Nobody", replacement="No one", sentence=2), Edit(original="3:", sentence=3)])
    assert "No one came" in text and len(done) == 1 and warnings == ["Ignored 1 proposed edit that quoted only the labels of the numbered view."]


def test_first_of_overlapping_edits_wins():
    _, done, warnings = apply_edits(TEXT, [Edit(original="Nobody came", replacement="None came", sentence=2), Edit(original="came", replacement="ran", sentence=2)])
    assert [e.replacement for e in done] == ["None came"] and "overlaps" in warnings[0]


def test_paragraph_stays():
    assert "empty" in one("Word", "", 2, "First one here.\n\nWord")[2][0]


def test_back_off_drops_the_heaviest():
    text = "aa bb cc dd ee ff gg hh"
    new, done, warnings = apply_edits(text, [Edit(original="aa bb", sentence=1), Edit(original="dd", sentence=1), Edit(original="ff", sentence=1)])
    assert new == "aa bb cc ee gg hh" and [e.original for e in done] == ["dd", "ff"] and "together the edits cut more" in warnings[0]


def test_typographic_quotes():
    assert locate("He said “no” — twice", 'said "no" - twice') == (1, 3, 20)
    assert locate("a b", "a  b") == (1, 0, 3) and locate("a a", "a")[0] == 2 and locate("a", "")[0] == locate("a", "b")[0] == 0


def test_splice_padding():
    assert splice("a [1] b", 2, 5, " x ") == "a x b"
    assert splice("a[1]b", 1, 4, " x ") == "a x b"
    assert splice("a (x), b", 2, 5, "") == "a, b"


def test_issues():
    assert issues("a b c", " ")[0] == ["nothing is left of the text"]
    found, report = issues("one two three four", "This section describes nothing")
    assert len(found) == 2 and report["lexical_retention"] == 0
    assert issues("Said (Ng 1999, Li 2000) so", "Said so")[1]["lexical_retention"] == 1.0


def test_measures():
    assert exact.words_changed("the old mill", "the new mill") == 2 and exact.words_dropped("a b", "") == 2
    assert exact.tokens("Straße ﬁne it’s") == ["strasse", "fine", "it’s"]


def test_applied_takes_nulls(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "A b.", [])], "id int, text string, edits array<struct<category:string,original:string,replacement:string,reason:string,sentence:int>>")
    got = {r["id"]: r["prepared_text"] for r in applied(rows).collect()}
    assert got == {1: "", 2: "A b."}


GOLD = "The mill burned. Nobody came."
SOURCE = "The mill burned (Ng 1999, Li 2001). Nobody came."
EXPECT = [{"anchor": "(Ng 1999, Li 2001)", "accept": [""], "category": "citation", "start": 16, "end": 34}]
TRAPS = [{"label": "subject", "start": 36, "end": 42}]


def test_scores():
    best = score.score_case(SOURCE, GOLD, EXPECT, TRAPS, GOLD)
    assert best["score"] == 1 and best["passed"] and best["output_matches_gold"]
    lazy = score.score_case(SOURCE, GOLD, EXPECT, TRAPS, SOURCE)
    assert lazy["recall"] == 0 and lazy["precision"] == 1 and lazy["fidelity_pass"] and abs(lazy["score"] - 0.3) < 1e-12
    vandal = score.score_case(SOURCE, GOLD, EXPECT, TRAPS, GOLD.replace("Nobody", "Everyone"))
    assert vandal["score"] == 0 and not vandal["fidelity_pass"] and {u["trap_label"] for u in vandal["unexpected"]} == {"subject"}
    spaced = score.score_case(SOURCE, GOLD, EXPECT, TRAPS, GOLD.replace("came.", "came ."))
    assert spaced["fidelity_pass"] and not spaced["passed"]
    failed = score.score_case(SOURCE, GOLD, EXPECT, TRAPS, SOURCE, error="x")
    assert failed["score"] == 0 and not failed["fidelity_pass"]


def test_regions_are_not_merged():
    assert [(r["source_text"], r["output_text"]) for r in score.change_regions("abcd", "axcy")] == [("b", "x"), ("d", "y")]
    assert score.contained({"source_start": 5, "source_end": 9, "source_text": " ab "}, 6, 8)
    assert score.overlaps({"source_start": 3, "source_end": 3}, 3, 5) and not score.overlaps({"source_start": 1, "source_end": 3}, 3, 5)


def test_protocol_counts():
    p = [Edit(original="zz", sentence=1), Edit(original="The mill", sentence=9), Edit(original="2:", sentence=1), Edit(original="Nobody", replacement="q w e r t y u i", sentence=2)]
    s = score.protocol(SOURCE + " The mill stood.", p, 0, 4)
    assert (s["unanchored"], s["ambiguous"], s["label_only"], s["oversized"]) == (1, 1, 1, 1)


def test_benchmark_ranks_the_stand_ins(spark):
    from lectern.plans import benchmark

    cases = spark.createDataFrame(
        [("c1", "trap", ["citation"], SOURCE, GOLD, [{**EXPECT[0], "why": "", "sentence": 1}], [{**TRAPS[0], "span": "Nobody"}])],
        "id string, tier string, categories array<string>, source string, prepared string, expect array<struct<anchor:string,accept:array<string>,category:string,why:string,start:int,end:int,sentence:int>>, traps array<struct<span:string,label:string,start:int,end:int>>",
    )
    v = spark.createDataFrame([(n, n, r, 41 + r) for n in ("eager", "flaky", "rules", "silent") for r in (1, 2)], "label string, model string, repetition int, seed int")
    rows = {r["label"]: r for r in benchmark.leaderboard(benchmark.case_runs(cases, v)).collect()}
    assert [r["label"] for r in sorted(rows.values(), key=lambda r: r["rank"])] == ["rules", "silent", "flaky", "eager"]
    assert rows["rules"]["score"] == 1 and rows["flaky"]["errors"] == 1 and rows["rules"]["determinism"] == 1


def test_words_changed_counts_whole_texts(spark, tmp_path):
    texts = ["x " * 150 + "with the path", "the " * 90, "a", "", None, "The the tHe " * 40 + "thin (Smith 1999, Jones 2001) [7]"]
    df = spark.createDataFrame([(k // 2, k % 2, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for t in texts:
        a, b = (Counter(exact.tokens(x)) for x in (t or "", (t or "").replace("th", "t")))
        n = sum((a - b).values()) + sum((b - a).values())
        want[n] = want.get(n, 0) + 1
    got = {r["changed"]: r["n"] for r in catalogue.QUERIES["words_changed"](spark, str(tmp_path)).collect()}
    assert got == want and sum(got.values()) == len(texts) and max(got) > 100


def test_opcodes_equal_the_matcher():
    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choices("ab ", k=r.randrange(9))) for _ in range(2))
        for x, y in ((a, b), (a + b, a), (a, b + a + b), (b + a + b, a)):
            assert score.opcodes(x, y) == SequenceMatcher(None, x, y, autojunk=False).get_opcodes()


def test_bags(spark):
    from lectern.functions import native

    r = random.Random(5)
    rows = [(k, r.choices("abcd", k=r.randrange(9)), r.choices("abce", k=r.randrange(9))) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    got = {x["k"]: (x["d"], x["o"]) for x in df.select("k", native.bag_difference(F.col("a"), F.col("b")).alias("d"), native.bag_overlap(F.col("a"), F.col("b")).alias("o")).collect()}
    for k, a, b in rows:
        x, y = Counter(a), Counter(b)
        assert got[k] == (sum((x - y).values()) + sum((y - x).values()), sum((x & y).values()))


def test_edits_by_a_plain_reading():
    """Random deletions: what is applied is what a reading of the rules one proposal at a time would apply."""
    r = random.Random(9)
    for _ in range(200):
        words = [r.choice(("oak", "elm", "ash", "fir", "yew")) + str(r.randrange(9)) for _ in range(r.randrange(6, 30))]
        text = " ".join(w + ("." if r.random() < 0.2 else "") for w in words)
        proposed = [Edit("c", r.choice(words), "", "", r.randrange(0, 4)) for _ in range(r.randrange(6))]
        new, done, warnings = apply_edits(text, proposed, Policy(retention=0.0))
        assert len(done) + len(warnings) == len(proposed)
        spans = exact.sentence_spans(text)
        taken = set()
        for e in proposed:
            a, b = spans[e.sentence - 1] if 0 < e.sentence <= len(spans) else (0, 0)
            near, far = text[a:b].count(e.original), text.count(e.original)
            at = a + text[a:b].index(e.original) if near == 1 else text.index(e.original) if near == 0 and far == 1 else None
            place = None if at is None else frozenset(range(at, at + len(e.original)))
            if place and not any(place & t for t in taken):
                taken.add(place)
        assert len(done) == len(taken)
        gone = set().union(*taken) if taken else set()
        assert new.replace(" ", "") == "".join(c for at, c in enumerate(text) if at not in gone and c != " ")


def test_bag_overlap_by_brute_force():
    r = random.Random(4)
    for _ in range(500):
        a, b = (r.choices("abc", k=r.randrange(8)) for _ in range(2))
        for x, y in ((a, b), (a + b, a), (a + b, a + ["z"] + b), (tuple(a + b), tuple(b))):
            assert exact.bag_overlap(x, y) == (Counter(x) & Counter(y)).total()


def test_benchmark_makes_each_run_once(spark):
    from lectern.plans import benchmark

    kind = "id string, tier string, categories array<string>, source string, prepared string, expect array<struct<anchor:string,accept:array<string>,category:string,why:string,start:int,end:int,sentence:int>>, traps array<struct<span:string,label:string,start:int,end:int>>"
    case = ("trap", ["citation"], SOURCE, GOLD, [{**EXPECT[0], "why": "", "sentence": 1}], [{**TRAPS[0], "span": "Nobody"}])
    cases = spark.createDataFrame([(f"c{n}", *case) for n in range(3)], kind)
    v = spark.createDataFrame([(n, n, r, 41 + r) for n in ("eager", "flaky", "nobody", "rules") for r in (1, 2, 3)], "label string, model string, repetition int, seed int")
    runs = benchmark.case_runs(cases, v, texts=False)
    assert not {"source", "gold", "prepared_text"} & set(runs.columns) and runs.count() == 36
    board = benchmark.leaderboard(runs)
    assert board._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {r["label"]: r for r in board.collect()}
    plain = {r["label"]: r for r in score.summary(runs, "label").collect()}
    stable = {r["label"]: r["d"] for r in score.determinism(runs.filter("error is null"), ("label", "case_id")).groupBy("label").agg(F.avg("determinism").alias("d")).collect()}
    for label, r in got.items():
        assert all(abs(r[c] - plain[label][c]) < 1e-12 for c in plain[label].asDict() if c != "label")
        assert r["determinism"] == stable.get(label)
    assert got["nobody"]["errors"] == 9 and got["flaky"]["errors"] == 3 and got["rules"]["proposed_edits"] == 9
