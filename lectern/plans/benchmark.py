"""Cases x variants x repetitions to scores, and their reports."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches, native
from ..operators import score
from ..operators.edits import EDIT, apply_edits
from .providers import preparers

ATTEMPT = f"prepared_text string, proposed array<{EDIT}>, applied array<{EDIT}>, warnings array<string>, error string, seconds double"
MEANS, PROTOCOL = ("score", "recall", "precision", "exactness"), ("proposed", "applied", "unanchored", "ambiguous", "oversized", "label_only")
#: Runs that are handed on at once.
FULL = 1000


def attempt(models: dict, name: str, source: str, seed: int, known: dict) -> tuple:
    """(prepared_text, proposed, applied, warnings, error, seconds) of an answer of the model of this name. Equal proposals to a source are applied
    once: known holds what came of them."""
    begun = time.perf_counter()
    try:
        model = models.get(name) or models.setdefault(name, preparers.create(name))
        proposed = tuple(model.propose(source, seed))
        if proposed not in known:
            new, done, warnings = apply_edits(source, list(proposed))
            known[proposed] = (new.strip(), list(proposed), done, warnings, None)
        out = known[proposed]
    except Exception as e:  # a provider may fail in any way; the run goes on
        out = (source, [], [], [], f"{type(e).__name__}: {e}")
    return (*out, time.perf_counter() - begun)


def case_runs(cases: DataFrame, variants: DataFrame, texts: bool = True) -> DataFrame:
    """A scored row for each case answered by each variant (label, model, repetition, seed); a failure is a row with its error.

    Variants are what a person asked for, a few rows. A case's runs are made where it lies, one after the other: its text
    is sent to Python once, whatever the number of variants, and is not shuffled, and equal answers are scored once. A task makes
    its models once. Without texts the rows lack those of the case and the answer, and what is told place by place.
    """
    own = [tuple(r) for r in variants.select("label", "model", "repetition", "seed").collect()]
    batches.bounded(cases.sparkSession)
    kinds = {{"prepared": "gold", "id": "case_id"}.get(c, c): cases.schema[c].dataType.simpleString() for c in cases.columns}
    names, long = list(kinds), [] if texts else ["source", "gold", "prepared_text", "expect", "traps", "outcomes"]
    kept = [c for c in names if c not in long]
    fields = [(c, kinds[c]) for c in kept] + [("label", "string"), ("model", "string"), ("repetition", "int"), ("seed", "int")]
    made = [x for x in (*ATTEMPT.split(", "), *score.SCORE.split(", ")) if x.split()[0] not in long]
    schema = ", ".join([f"`{c}` {k}" for c, k in fields] + made)
    tried = [x.split()[0] for x in ATTEMPT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict = {}
        for batch in frames:
            out = []
            for case in (dict(zip(names, row, strict=True)) for row in batch.itertuples(index=False, name=None)):
                known, scores = {}, {}
                expect, traps = [dict(x) for x in case["expect"]], [dict(x) for x in case["traps"]]
                for label, name, repetition, seed in own:
                    done = attempt(models, name, case["source"], int(seed), known)
                    new, proposed, applied, warnings, error, _ = done
                    key = error if error is not None else tuple(proposed)
                    if (error is None, key) not in scores:
                        scores[error is None, key] = score.score_case(case["source"], case["gold"], expect, traps, new, proposed, len(applied), len(warnings), error)
                    row = dict(zip(tried, done, strict=True)) | {"proposed": [asdict(e) for e in proposed], "applied": [asdict(e) for e in applied]}
                    row |= {"label": label, "model": name, "repetition": repetition, "seed": seed} | scores[error is None, key]
                    out.append({c: case[c] for c in kept} | {c: v for c, v in row.items() if c not in long})
                if len(out) >= FULL:
                    yield pd.DataFrame(out)
                    out = []
            if out:
                yield pd.DataFrame(out)

    done = cases.mapInPandas(run, schema)
    labels = F.array_distinct(F.filter(F.transform("unexpected", lambda u: u["trap_label"]), lambda x: x.isNotNull()))
    pair = lambda e: F.struct(native.collapse(e["original"]).alias("o"), native.collapse(e["replacement"]).alias("r"))
    return done.withColumns({"trap_labels": labels, "signature": F.array_distinct(F.transform("proposed", pair)), "run": F.concat_ws("/", "label", "repetition", "case_id")})


def leaderboard(runs: DataFrame) -> DataFrame:
    """A ranked row for each variant, with its determinism and how its proposals fared. Runs are read once: first by case,
    whose repetitions are few, and then by variant."""
    sums = {c: F.sum(c) for c in MEANS} | {f"n_{c}": F.count(c) for c in MEANS}
    sums |= {c: F.sum(f"protocol.{c}") for c in PROTOCOL} | {"cases": F.count("*"), "n_passed": F.count_if("passed"), "unfaithful": F.count_if(~F.col("fidelity_pass")), "errors": F.count("error")}
    answers = F.collect_list(F.when(F.col("error").isNull(), F.struct("repetition", "signature")))
    by_case = runs.groupBy("label", "case_id").agg(*[v.alias(c) for c, v in sums.items()], answers.alias("answers"))
    by_case = by_case.withColumn("determinism", score.agreement(F.col("answers")))
    rows = by_case.groupBy("label").agg(*[F.sum(c).alias(c) for c in sums], F.avg("determinism").alias("determinism"))
    rows = rows.select(
        "label", "cases", F.col("n_passed").alias("passed"), *[F.coalesce(F.try_divide(c, f"n_{c}"), F.lit(0.0)).alias(c) for c in MEANS], F.col("unfaithful").alias("fidelity_failures"),
        F.col("proposed").alias("proposed_edits"), F.col("applied").alias("applied_edits"), "unanchored", "ambiguous", "oversized", "label_only", "errors", "determinism",
    )
    rate = score.anchor_failure_rate(F.col("unanchored"), F.col("ambiguous"), F.col("proposed_edits"))
    return score.ranked(rows.withColumn("anchor_failure_rate", rate), "label")


@dataclass(frozen=True)
class Options:
    """What a run is asked for. Bad values are refused before any model is loaded."""

    models: tuple[str, ...]
    think: tuple[bool, ...] = (False,)
    never_thinking: tuple[str, ...] = ()
    repetitions: int = 2
    appendix: int = 5

    def __post_init__(self) -> None:
        names = tuple(m.strip() for m in self.models if m.strip())
        if not names or len(set(names)) < len(names):
            raise ValueError("models have to be named, each once")
        if not self.think:
            raise ValueError("a thinking mode is needed")
        if self.repetitions < 1 or self.appendix < 0:
            raise ValueError("repetitions count from 1, the appendix from 0")
        object.__setattr__(self, "models", names)
        object.__setattr__(self, "think", tuple(dict.fromkeys(self.think)))

    def variants(self, spark: SparkSession) -> DataFrame:
        frame = lambda rows, kind: spark.createDataFrame(rows, kind)
        blocked = frame([(m, True) for m in self.never_thinking], "model string, think boolean")
        return score.variants(frame([(m,) for m in self.models], "model string"), frame([(t,) for t in self.think], "think boolean"), blocked, self.repetitions)
