"""Judging prepared passages against gold answers, and the reports over many of them."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions import patterns as P
from .edits import Edit, Passage, Policy, unlabelled

REGION = "struct<source_start:int,source_end:int,source_text:string,output_text:string>"
SCORE = (
    "recall double, precision double, exactness double, fidelity_pass boolean, score double, passed boolean, output_matches_gold boolean, "
    "outcomes array<struct<anchor:string,category:string,status:string,observed:string>>, "
    "unexpected array<struct<source_text:string,output_text:string,words_changed:int,severity:string,trap_label:string>>, "
    "protocol struct<proposed:int,applied:int,refused:int,label_only:int,unanchored:int,ambiguous:int,oversized:int>"
)

# One case


def opcodes(source: str, prepared: str) -> list[tuple[str, int, int, int, int]]:
    """SequenceMatcher's, which takes the square of the length; at once where one text lies whole in the other, as its
    longest match is then all of it, at the first place."""
    n, m = len(source), len(prepared)
    if n and m and (at := source.find(prepared)) >= 0:
        parts = [("delete", 0, at, 0, 0), ("equal", at, at + m, 0, m), ("delete", at + m, n, m, m)]
    elif n and m and (at := prepared.find(source)) >= 0:
        parts = [("insert", 0, 0, 0, at), ("equal", 0, n, at, at + n), ("insert", n, n, at + n, m)]
    else:
        return SequenceMatcher(None, source, prepared, autojunk=False).get_opcodes()
    return [p for p in parts if p[1] < p[2] or p[3] < p[4]]


def change_regions(source: str, prepared: str, codes: list | None = None) -> list[dict]:
    """Each differing span apart; neighbours are never merged. codes: opcodes(), if known."""
    return [
        {"source_start": a, "source_end": b, "source_text": source[a:b], "output_text": prepared[c:d]}
        for tag, a, b, c, d in (opcodes(source, prepared) if codes is None else codes)
        if tag != "equal"
    ]


def overlaps(region: dict, start: int, end: int) -> bool:
    """A region without width belongs to the span it touches."""
    a, b = region["source_start"], region["source_end"]
    return start <= a <= end if a == b else a < end and start < b


def trimmed(region: dict) -> tuple[int, int]:
    """Without white space at its ends; a point, if it has nothing else."""
    text, a = region["source_text"], region["source_start"]
    lead = len(text) - len(text.lstrip())
    return a + lead, max(a + lead, a + len(text.rstrip()))


def contained(region: dict, start: int, end: int) -> bool:
    a, b = trimmed(region)
    return start <= a and b <= end


def projected(codes: list, prepared: str, start: int, end: int) -> str:
    """What stands in the output for source[start:end]: from where the opcodes put its first character, or an insertion just
    before it, to where they put its last one."""
    ends = [len(prepared), len(prepared)]
    for tag, a, b, c, d in reversed(codes):
        same = tag == "equal"
        if a <= start < b or a == b == start:
            ends[0] = c + same * (start - a)
        if a < end <= b:
            ends[1] = c + end - a if same else d
    return prepared[ends[0] : max(ends)]


def uncontained(regions: DataFrame, expected: DataFrame, case: str) -> DataFrame:
    """Changed regions (case, start, end, ...) that no expected span of their case contains: an equi-join on the case, with
    containment as its condition."""
    r, e = regions.alias("r"), expected.alias("e")
    inside = (F.col(f"r.{case}") == F.col(f"e.{case}")) & (F.col("e.start") <= F.col("r.start")) & (F.col("r.end") <= F.col("e.end"))
    return r.join(e, inside, "left_anti")


def omitted(known: Column, given: Column) -> Column:
    """Options that a model was left to choose by itself, in order."""
    return F.sort_array(F.array_except(known, given))


#: What a refusal counts as; the others count as unanchored.
KINDS = {"elsewhere more than once": "ambiguous", "rewrite": "oversized", "summary": "oversized", "": None}


def protocol(source: str, proposed: list[Edit], applied: int, refused: int, policy: Policy | None = None) -> dict:
    """Why proposals did not survive, by the rules of the applier on each by itself."""
    passage, bare = Passage(source, policy or Policy()), unlabelled(proposed)
    judged = passage.judged([e for e in bare if e is not None], (Passage.place, Passage.crosses, Passage.rewrites))
    kinds = Counter(KINDS.get(j.rule, "unanchored") for j in judged)
    counts = {"proposed": len(proposed), "applied": applied, "refused": refused, "label_only": bare.count(None)}
    return counts | {k: kinds[k] for k in ("unanchored", "ambiguous", "oversized")}


def score_case(
    source: str, gold: str, expect: list[dict], traps: list[dict], prepared: str, proposed: list[Edit] = (), applied: int = 0,
    refused: int = 0, error: str | None = None,
) -> dict:
    """expect: anchor, accept, category, start, end; traps: label, start, end."""
    stats = protocol(source, list(proposed), applied, refused)
    if error is not None:
        zero = dict.fromkeys(("recall", "precision", "exactness", "score"), 0.0)
        return {**zero, "fidelity_pass": False, "passed": False, "output_matches_gold": False, "outcomes": [], "unexpected": [], "protocol": stats}
    codes = opcodes(source, prepared)
    regions = change_regions(source, prepared, codes)
    outcomes = []
    for x in expect:
        touched = any(overlaps(r, x["start"], x["end"]) for r in regions)
        seen = projected(codes, prepared, x["start"], x["end"]) if touched else x["anchor"]
        fits = exact.collapse(seen) in map(exact.collapse, x["accept"])
        outcomes.append({"anchor": x["anchor"], "category": x["category"], "status": "missed" if not touched else "exact" if fits else "approximate", "observed": seen})
    unexpected = []
    for r in regions:
        if any(contained(r, x["start"], x["end"]) for x in expect):
            continue
        n = exact.words_changed(r["source_text"], r["output_text"])
        cosmetic = n == 0 or exact.collapse(r["source_text"]) == exact.collapse(r["output_text"])
        label = next((t["label"] for t in traps if overlaps(r, t["start"], t["end"])), None)
        unexpected.append({"source_text": r["source_text"], "output_text": r["output_text"], "words_changed": n, "severity": "cosmetic" if cosmetic else "substantive", "trap_label": label})
    found, right = (sum(o["status"] in kinds for o in outcomes) for kinds in (("exact", "approximate"), ("exact",)))
    share = lambda n, of: n / of if of else 1.0
    recall, exactness, precision = share(found, len(outcomes)), share(right, len(outcomes)), share(found, found + len(unexpected))
    faithful = all(u["severity"] == "cosmetic" for u in unexpected)
    w = P.SCORE_WEIGHTS
    return {
        "recall": recall, "precision": precision, "exactness": exactness, "fidelity_pass": faithful,
        "score": w["recall"] * recall + w["precision"] * precision + w["exactness"] * exactness if faithful else 0.0,
        "passed": faithful and recall == 1 and exactness == 1 and not unexpected, "output_matches_gold": prepared.strip() == gold,
        "outcomes": outcomes, "unexpected": unexpected, "protocol": stats,
    }


def scored(attempts: DataFrame) -> DataFrame:
    """attempts (source, gold, expect, traps, prepared_text, proposed, applied, warnings, error) with their scores."""

    @F.pandas_udf(SCORE)
    def run(source: pd.Series, gold: pd.Series, expect: pd.Series, traps: pd.Series, prepared: pd.Series, proposed: pd.Series, applied: pd.Series, refused: pd.Series, error: pd.Series) -> pd.DataFrame:
        rows = [
            score_case(s, g, [dict(x) for x in e], [dict(x) for x in t], p if p is not None else s, [Edit.of(x) for x in d], int(n), int(r), q)
            for s, g, e, t, p, d, n, r, q in zip(source, gold, expect, traps, prepared, proposed, applied, refused, error, strict=True)
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCORE.split(", ")])

    sizes = (F.coalesce(F.size("applied"), F.lit(0)), F.coalesce(F.size("warnings"), F.lit(0)))
    s = run("source", "gold", "expect", "traps", "prepared_text", F.coalesce("proposed", F.array().cast(attempts.schema["proposed"].dataType)), *sizes, "error")
    return attempts.withColumn("_s", s).select("*", "_s.*").drop("_s")


# Many runs


def summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Cases, passes, mean scores and fidelity failures of each group."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("score", "recall", "precision", "exactness")]
    return runs.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), *means, F.count_if(~F.col("fidelity_pass")).alias("fidelity_failures")
    )


def by_category(runs: DataFrame, *keys: str) -> DataFrame:
    """A run counts in each of its categories."""
    return summary(runs.withColumn("category", F.explode("categories")), *keys, "category")


def ranked(reports: DataFrame, order: str = "variant") -> DataFrame:
    """Fewest fidelity failures, then highest score, then most passes; equals keep the order of their variants.

    A row for each variant: the single partition of this window is as small as their number.
    """
    w = Window.orderBy("fidelity_failures", F.desc("score"), F.desc("passed"), order)
    return reports.withColumn("rank", F.row_number().over(w))


def matrix(runs: DataFrame, row: str, column: str, labels: list[str], value: Column) -> DataFrame:
    """value of each row label by column label; labels are given, so the pivot needs no pass to find them."""
    return runs.groupBy(row).pivot(column, labels).agg(value)


def trap_failures(runs: DataFrame, *keys: str) -> DataFrame:
    """How many runs fell into each trap, each run once; `first_run` orders equals."""
    hits = runs.select(*keys, "run", F.explode(F.array_distinct("trap_labels")).alias("label"))
    return hits.groupBy(*keys, "label").agg(F.count("*").alias("failures"), F.min("run").alias("first_run"))


def determinism(signatures: DataFrame, key: tuple[str, ...], repetition: str = "repetition", signature: str = "signature") -> DataFrame:
    """Mean Jaccard similarity of the repetitions of a case, pair by pair; null for fewer than two.

    Repetitions are few, by the number that a benchmark is told to make.
    """
    a = signatures.select(*key, F.col(repetition).alias("i"), F.col(signature).alias("x"))
    b = signatures.select(*key, F.col(repetition).alias("j"), F.col(signature).alias("y"))
    union = F.size(F.array_union("x", "y"))
    like = F.when(union > 0, F.size(F.array_intersect("x", "y")) / union).otherwise(1.0)
    pairs = a.join(b, list(key)).filter("i < j").groupBy(*key).agg(F.avg(like).alias("determinism"))
    return signatures.select(*key).distinct().join(pairs, list(key), "left")


def agreement(answers: Column) -> Column:
    """determinism() of one case, from an array of its (repetition, signature)."""
    like = lambda x, y: F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(1.0)
    later = lambda x: F.filter(answers, lambda y: y["repetition"] > x["repetition"])
    pairs = F.flatten(F.transform(answers, lambda x: F.transform(later(x), lambda y: like(x["signature"], y["signature"]))))
    return F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x), F.size(pairs))


def failures(runs: DataFrame, group: str, most: int) -> DataFrame:
    """The worst failed runs of each group's first repetition, and how many more there are."""
    own = runs.filter((F.col("repetition") == 1) & ~F.col("passed"))
    w = Window.partitionBy(group).orderBy("fidelity_pass", "score", "case_id")
    first = own.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)  # limited before the shuffle
    counts = own.groupBy(group).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return first.join(counts, group)


def anchor_failure_rate(unanchored: Column, ambiguous: Column, proposed: Column) -> Column:
    return F.when(proposed > 0, (unanchored + ambiguous) / proposed).otherwise(0.0)


def seed(repetition: Column) -> Column:
    return F.when(repetition >= 1, repetition + (P.SEED - 1)).otherwise(F.raise_error(F.lit("repetitions count from 1")).cast("int"))


def variants(models: DataFrame, modes: DataFrame, blocked: DataFrame, repetitions: int) -> DataFrame:
    """model x thinking mode without the blocked pairs, x repetition: as many rows as the benchmark has runs of a case."""
    both = F.array(*[F.lit(r["think"]) for r in modes.select("think").distinct().collect()])  # two at most
    wanted = models.withColumn("think", F.explode(both)).join(blocked, ["model", "think"], "left_anti")
    label = F.when(F.col("think"), F.concat("model", F.lit(" +think"))).otherwise(F.col("model"))
    return wanted.withColumn("label", label).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("seed", seed(F.col("repetition")))
