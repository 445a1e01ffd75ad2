"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts by language in the cluster over a sample of bounded size, one
matrix a task; the log-probability matrix (languages x buckets, a few MB whatever the corpus)
is broadcast. Scoring treats texts as a sparse matrix of documents by buckets in CSR form
and multiplies it with the broadcast matrix in numpy, few texts at a time.

Null, empty and letterless texts are predicted `und` with score 0; letters are what str.isalpha
says, so numerals of any kind are none. A table without labelled
texts gives a model of no language, which predicts `und` for all. Rows are independent, so
repeated rows get equal results; columns other than the named ones are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
_SLICE = 1 << 17
#: Characters that are scored or counted at once, about: what is made of the former fits a core's cache.
_SCORED, _COUNTED = 1 << 15, 1 << 18


@cache
def _alphabet() -> np.ndarray:
    """Which characters are letters."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters of each text, where each run of anything else is one space, with one at either
    end; and the start of each text, with the end as a last entry."""
    padded = [f" {t.lower()} " if t else "  " for t in texts]
    starts, _ = common.flat(padded)
    code = _codes("".join(padded))
    yes = _alphabet()[code]
    keep = yes.copy()
    keep[1:] |= yes[:-1]
    keep[starts[:-1]] = True
    kept = np.zeros(len(code) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    bare = np.diff(kept[starts]) == 1  # without letters, so the space at the end follows none
    if bare.any():
        keep[starts[1:][bare] - 1] = True
        np.cumsum(keep, out=kept[1:])
    return np.where(yes, code, np.uint32(32))[keep], kept[starts]


def normalized(text: str | None) -> str:
    """Lower-cased letters; each run of anything else becomes one space, with one at either end."""
    return letters([text])[0].tobytes().decode("utf-32-le", "surrogatepass")


def ngram_buckets(code: np.ndarray, ends: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """For each order, the bucket of the n-gram that begins at each code point; 2**bits where it would reach over an end.

    A hash h of n is h * 0x100000001B3 + c for each code point c in turn, then multiplied once more: all by sums of products.
    """
    code = code.astype(np.uint64)
    factor = [0x9E3779B97F4A7C15 * 0x100000001B3**k % (1 << 64) for k in range(max(orders) + 1)]
    product = [code * np.uint64(f) for f in factor[:-1]]
    out = np.full((len(orders), len(code)), 1 << bits, np.intp)
    for row, n in zip(out, orders, strict=True):
        whole = max(0, len(code) - n + 1)
        h = product[n - 1][:whole] + np.uint64(n * factor[n] % (1 << 64))
        for k in range(1, n):
            h += product[n - 1 - k][k : k + whole]
        row[:whole] = h >> np.uint64(64 - bits)
        for back in range(1, n):  # if this lies in the text before, an n-gram there reaches over its end as well
            at = ends - back
            row[at[at >= 0]] = 1 << bits
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # (2**bits + 1, languages); the last row is zero
    orders: tuple[int, ...]
    bits: int

    def log_joint(self, texts: list[str]) -> np.ndarray:
        """Sparse counts of normalized texts times log-probabilities."""
        starts, _ = common.flat(texts)
        return self._sums(_codes("".join(texts)), starts) + self.log_prior

    def _sums(self, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums of log-probabilities, by slices of bounded size; a text may span slices."""
        out = np.zeros((len(starts) - 1, len(self.languages)))
        full, reach = np.flatnonzero(np.diff(starts)), max(self.orders) - 1
        begins = starts[full]
        for at in range(0, len(code), _SLICE):
            part = code[at : at + _SLICE + reach]
            ends = starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, at + len(part), "right")] - at
            index = ngram_buckets(part, ends, self.orders, self.bits)[:, :_SLICE]
            first, last = np.searchsorted(begins, at, "right") - 1, np.searchsorted(begins, at + index.shape[1])
            own = np.maximum(begins[first:last] - at, 0)
            for column, log_prob in enumerate(self._columns):
                values = log_prob[index[0]]
                for more in index[1:]:
                    values += log_prob[more]
                out[full[first:last], column] += np.add.reduceat(values, own)
        return out

    @cached_property
    def _columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.log_prob.T)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_columns"}

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language, -1 for none, and its posterior probability."""
        common.held("language", dict)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.languages:
            return best, score
        for own in common.runs([len(t) if t else 0 for t in texts], _SCORED):
            code, starts = letters(texts[own])
            joint = self._sums(code, starts) + self.log_prior
            joint -= joint.max(axis=1, keepdims=True)
            p = np.exp(joint)
            p /= p.sum(axis=1, keepdims=True)
            has = np.diff(starts) > 2
            best[own], score[own] = np.where(has, p.argmax(axis=1), -1), np.where(has, p.max(axis=1), 0)
        return best, score


def train(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
    orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, sample_per_language: int | None = 4000, smoothing: float = 0.1,
) -> LanguageModel:
    """Counts n-grams by language over about sample_per_language texts of each, or over all.

    The number of languages is taken to be that of natural languages: its counts fit the driver.
    """
    common.bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l"))
    rows = rows.filter(F.col("t").isNotNull() & F.col("l").isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros(((1 << bits) + 1, 0)), orders, bits)
    picked = rows
    if sample_per_language is not None:
        share = F.element_at(
            F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, sample_per_language / counts[l]))]), F.col("l")
        )
        picked = rows.filter(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        common.held("language", dict)  # what other operators have this worker remember goes
        for batch in batches:
            for lang, own in batch.groupby("l"):
                texts = own["t"].tolist()
                for part in common.runs([len(t) for t in texts], _COUNTED):
                    code, starts = letters(texts[part])
                    index = ngram_buckets(code, starts[1:], orders, bits)
                    add = np.bincount(index.ravel(), minlength=(1 << bits) + 1)[:-1]
                    total[lang] = total[lang] + add if lang in total else add
            common.trim()
        for lang, n in total.items():
            yield pd.DataFrame({"l": [lang], "n": [n.astype(np.int64).tobytes()]})

    sums = {l: np.zeros(1 << bits, np.int64) for l in languages}
    for row in picked.mapInPandas(count, "l string, n binary").toLocalIterator():
        sums[row["l"]] += np.frombuffer(row["n"], np.int64)
    n = np.stack([sums[l] for l in languages], axis=1) + smoothing
    log_prob = np.zeros(((1 << bits) + 1, len(languages)))
    log_prob[:-1] = np.log(n / n.sum(axis=0))
    prior = np.array([counts[l] for l in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), log_prob, orders, bits)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; all other columns stay as they are. Clashing old columns are replaced."""
    common.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        parts = [sent.value.predict(texts.iloc[at : at + 500].tolist()) for at in range(0, max(1, len(texts)), 500)]
        best, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        common.trim()
        names = np.array([*sent.value.languages, UNDETERMINED], object)
        return pd.DataFrame({"lang_pred": names[best], "score": score})

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], label(F.col(text)).alias("_label")).select(
        *[F.col(f"`{c}`") for c in keep], "_label.lang_pred", "_label.score"
    )


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those that are not held out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~common.held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """Documents with a language that the model is sure of by `least` or more; columns stay."""
    names = docs.columns
    return identify(docs, model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*names)
