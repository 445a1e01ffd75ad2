"""Toxicity scores by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the rows of a hashed table for the word itself and its first
four, five and six characters, so that inflected forms share weights. Filters of several widths
slide over the embeddings; their maxima over the whole text feed a logistic layer. The network is
trained in numpy: on the driver as far as labelled texts are few, and in a pass of the cluster over all
labelled texts if there are more, of which only sums reach the driver. Thresholds are
then calibrated on labelled texts kept out of a second network's training, one for each language group as a
language model over the text itself tells it, which counts all texts. A monotone map within the group moves its
threshold to 0.7.

Scoring keeps, for each word that a worker has met, the products of its embedding with all
filter taps: a text costs a gather and a few sums for each word, in slices of bounded length.

Null and empty texts have a maximum of zero in every filter, and the low score that follows from
the bias. Without labelled texts of both kinds all scores are 0. Repeated rows get equal scores;
a text with several labels counts once for each. Other columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, language

THRESHOLD = 0.7
#: Labelled texts of either kind that networks start from at most, about.
SAMPLE = 2500
#: Labels are broadcast up to so many bytes, at so many each.
MARK_BYTES, BROADCAST_BYTES = 64, 32 << 20
WIDTHS, FILTERS, DIMENSIONS, BITS = (1, 2, 3), 8, 16, 16
PARTS = 4
_SLICE = 1 << 17
#: Words that are scored at once, about: their products fit a core's cache.
_BLOCK = 1 << 12


class Numbered(dict):
    """Numbers words as they are first asked for; `fresh` holds those met since it was last emptied, in order."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def buckets(word: bytes) -> tuple[int, ...]:
    """Rows of the embedding table for a word and its beginnings."""
    parts = (word + b"$", *(word[:n] for n in (4, 5, 6)))
    return tuple(xxhash.xxh3_64_intdigest(p) >> (64 - BITS) for p in parts)


def buckets_of(words: list[bytes]) -> np.ndarray:
    """The same for many words, a row each."""
    digest = xxhash.xxh3_64_intdigest
    beginnings: dict[bytes, int] = {}
    out = np.empty((len(words), PARTS), np.uint64)
    out[:, 0] = np.fromiter((digest(w + b"$") for w in words), np.uint64, len(words))
    for k, n in enumerate((4, 5, 6), 1):
        cut = [w[:n] for w in words]
        for p in set(cut).difference(beginnings):
            beginnings[p] = digest(p)
        out[:, k] = np.fromiter(map(beginnings.__getitem__, cut), np.uint64, len(words))
    return (out >> np.uint64(64 - BITS)).astype(np.int32)


def tokens(text: str | None) -> list[bytes]:
    return common.words(text)


def summed(embedding: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Embeddings of words from their rows of the table."""
    out = embedding[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        out += embedding[rows[:, k]]
    return out


@dataclass
class Network:
    embedding: np.ndarray
    taps: list[np.ndarray]  # for each width (width, dimensions, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    languages: language.LanguageModel | None = None
    _rows: Numbered = field(default_factory=Numbered, repr=False)
    _products: np.ndarray | None = field(default=None, repr=False)

    @staticmethod
    def new(seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        return Network(
            r.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32),
            [r.normal(0, (w * DIMENSIONS) ** -0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), -2.0,
        )

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_rows": Numbered(), "_products": None}

    # Scoring

    def _word_rows(self, words: list[bytes]) -> np.ndarray:
        """Rows of the table of products, which grows with new words and starts anew when it is large."""
        if self._products is None or len(self._rows) > 300_000:
            self._rows, self._products = Numbered(), np.zeros((1 << 14, sum(WIDTHS) * FILTERS), np.float32)
        out = np.fromiter(map(self._rows.__getitem__, words), np.intp, len(words))
        missing = self._rows.fresh
        if missing:
            index = buckets_of(missing)
            taps = np.concatenate([t.transpose(1, 0, 2).reshape(DIMENSIONS, -1) for t in self.taps], axis=1)
            need = len(self._rows)
            if need > len(self._products):
                grown = np.zeros((max(need, 2 * len(self._products)), self._products.shape[1]), np.float32)
                grown[: len(self._products)] = self._products
                self._products = grown
            self._products[need - len(missing) : need] = summed(self.embedding, index) @ taps
            missing.clear()
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Maxima of every filter over each text."""
        out = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        reach, held, rows, n = max(WIDTHS) - 1, [], [], 0
        for k, text in enumerate(texts):
            own = tokens(text)
            if len(own) > _SLICE:  # one long text: overlapping slices
                out[k] = np.max([self._maxima([own[at : at + _SLICE + reach]])[0] for at in range(0, len(own), _SLICE)], axis=0)
                continue
            if n + len(own) > _SLICE:
                out[rows] = self._maxima(held)
                held, rows, n = [], [], 0
            held.append(own)
            rows.append(k)
            n += len(own)
        if held:
            out[rows] = self._maxima(held)
        return out

    def _maxima(self, texts: list[list[bytes]]) -> np.ndarray:
        out = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        starts, lengths = common.flat(texts)
        rows = self._word_rows(list(chain.from_iterable(texts)))
        for own in common.runs(lengths, _BLOCK):
            out[own] = self._pooled(rows[starts[own.start] : starts[own.stop]], starts[own.start : own.stop + 1] - starts[own.start])
        return out

    def _pooled(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts) - 1, len(WIDTHS) * FILTERS), np.float32)
        full = np.flatnonzero(np.diff(starts))
        if not len(full):
            return out
        p, value = self._products.take(rows, axis=0), np.empty((len(rows), out.shape[1]), np.float32)
        column = 0
        for k, width in enumerate(WIDTHS):
            own = value[:, k * FILTERS : (k + 1) * FILTERS]
            np.add(p[:, column : column + FILTERS], self.bias[k], out=own)
            for tap in range(1, width):
                own[: len(p) - tap] += p[tap:, column + tap * FILTERS : column + (tap + 1) * FILTERS]
            for tap in range(1, width):  # windows that would reach into the next text
                at = starts[1:] - tap
                own[at[at >= starts[:-1]]] = 0
            column += width * FILTERS
        out[full] = np.maximum.reduceat(value, starts[:-1][full], axis=0)
        return np.maximum(out, 0)

    def raw(self, texts: list[str | None]) -> np.ndarray:
        z = self.features(texts).astype(np.float64) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def groups(self, texts: list[str | None]) -> np.ndarray:
        names = np.array([*self.languages.languages, language.UNDETERMINED], object)
        return names[self.languages.predict(texts)[0]]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        p = self.raw(texts)
        t = np.array([self.thresholds.get(g, self.thresholds[""]) for g in self.groups(texts)]) if len(self.thresholds) > 1 else self.thresholds[""]
        return np.where(p < t, THRESHOLD * p / t, THRESHOLD + (1 - THRESHOLD) * (p - t) / (1 - t))


def gradients(
    net: Network, ids: list[np.ndarray], table: np.ndarray, labels: np.ndarray, weights: np.ndarray, grads: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds the gradients of the weighted logistic losses of texts (places of words in a table of their bucket rows) to those of
    taps, biases and output, and returns those of the output's bias, and the embedding rows touched with theirs.

    Products with all taps are made once for each different word; gradients pass where a maximum is positive."""
    starts, _ = common.flat(ids)
    words, seen = np.concatenate(ids), np.zeros(len(table), bool)
    seen[words] = True
    own = np.flatnonzero(seen)
    place = np.empty(len(table), np.intp)
    place[own] = np.arange(len(own))
    rows, words = table[own], place[words]
    x = summed(net.embedding, rows)
    peak, best = np.zeros((len(ids), len(WIDTHS) * FILTERS), np.intp), np.zeros((len(ids), len(WIDTHS) * FILTERS), x.dtype)
    for k, width in enumerate(WIDTHS):
        v = np.full((FILTERS, len(words)), -np.inf, x.dtype)
        n = len(words) - width + 1
        if n < 1:
            continue
        v[:, :n] = sum((x @ net.taps[k][tap]).T.take(words[tap : tap + n], axis=1) for tap in range(width)) + net.bias[k][:, None]
        columns = slice(k * FILTERS, (k + 1) * FILTERS)
        for d, (begin, end) in enumerate(zip(starts[:-1].tolist(), (starts[1:] - width + 1).tolist(), strict=True)):
            if begin < end:
                at = v[:, begin:end].argmax(axis=1) + begin
                peak[d, columns], best[d, columns] = at, v[np.arange(FILTERS), at]
    pooled = np.maximum(best, 0)
    z = pooled @ net.out + net.out_bias
    g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) * weights
    grads[-1] += g @ pooled
    touched, values = [np.empty((0, PARTS), rows.dtype)], [np.empty((0, DIMENSIONS), x.dtype)]
    for k, width in enumerate(WIDTHS):
        columns = slice(k * FILTERS, (k + 1) * FILTERS)
        text, filter_ = np.nonzero(pooled[:, columns])
        back = g[text] * net.out[columns][filter_]
        grads[len(WIDTHS) + k] += np.bincount(filter_, back, FILTERS)
        to = np.zeros((len(back), FILTERS), back.dtype)
        to[np.arange(len(back)), filter_] = back
        at = peak[text, k * FILTERS + filter_]
        for tap in range(width):
            word = words[at + tap]
            grads[k][tap] += x[word].T @ to
            touched.append(rows[word])
            values.append(net.taps[k][tap].T[filter_] * back[:, None])
    return g, np.concatenate(touched), np.repeat(np.concatenate(values)[:, None, :], PARTS, axis=1)


def backward(net: Network, own: np.ndarray, label: float, weight: float, grads: list[np.ndarray]) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """The same for one text, from the bucket rows of its words."""
    g, touched, values = gradients(net, [np.arange(len(own))], own, np.array([label]), np.array([weight]), grads)
    return float(g[0]), [touched], [values]


def numbered(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's words as places in a table of their embedding rows, and that table."""
    vocabulary = Numbered()
    ids = [np.fromiter(map(vocabulary.__getitem__, tokens(t)), np.int32) for t in texts]
    return ids, buckets_of(vocabulary.fresh)


class Descent:
    """Adam on the logistic loss of a network, whose gradients pass through the positions of the maxima."""

    def __init__(self, net: Network, rate: float = 0.01, batch: int = 64, seed: int = 5):
        self.net, self.rate, self.batch, self.random, self.step = net, rate, batch, np.random.default_rng(seed), 0
        self.dense = [*net.taps, *net.bias, net.out]
        self.first, self.second = [np.zeros_like(x) for x in self.dense], [np.zeros_like(x) for x in self.dense]
        self.e_second = np.zeros(len(net.embedding), np.float32)

    def epoch(self, ids: list[np.ndarray], table: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        net, batch = self.net, self.batch
        order = self.random.permutation(len(ids))
        for at in range(0, len(order), batch):
            grads = [np.zeros_like(x) for x in self.dense]
            touched: list[np.ndarray] = []
            values: list[np.ndarray] = []
            bias_grad, self.step, now = 0.0, self.step + 1, order[at : at + batch]
            for part in common.runs([len(ids[d]) for d in now], _BLOCK):
                own = now[part]
                g, rows, parts = gradients(net, [ids[d] for d in own], table, labels[own], weight[own] / batch, grads)
                bias_grad += g.sum()
                touched.append(rows)
                values.append(parts)
            scale = self.rate * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
            for x, g, m, v in zip(self.dense, grads, self.first, self.second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= scale * m / (np.sqrt(v) + 1e-8)
            net.out_bias -= self.rate * bias_grad
            if any(map(len, touched)):
                rows, back_to = np.unique(np.concatenate(touched).ravel(), return_inverse=True)
                cells = (back_to.reshape(-1, 1) * DIMENSIONS + np.arange(DIMENSIONS)).ravel()
                total = np.bincount(cells, np.concatenate(values).ravel(), len(rows) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float32)
                self.e_second[rows] += (total * total).mean(axis=1)
                net.embedding[rows] -= 0.05 * total / (np.sqrt(self.e_second[rows])[:, None] + 1e-8)


def descended(texts: list[str], labels: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 5) -> Descent:
    """A descent over the texts; both kinds weigh alike.

    One in fifty examples is an empty text that is not toxic, so that having no words counts for nothing.
    """
    blank = max(1, len(texts) // 50)
    texts, labels = [*texts, *[""] * blank], np.append(labels, np.zeros(blank, labels.dtype))
    ids, table = numbered(texts)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    out = Descent(Network.new(), rate, batch, seed)
    for _ in range(epochs):
        out.epoch(ids, table, labels, weight)
    return out


def fit(texts: list[str], labels: np.ndarray, **more) -> Network:
    return descended(texts, labels, **more).net


def _vectors(net: Network) -> np.ndarray:
    """All weights as rows of one width: the embedding's, then the others'."""
    rest = np.concatenate([*(x.ravel() for x in (*net.taps, *net.bias, net.out)), [net.out_bias]])
    return np.concatenate([net.embedding, np.pad(rest, (0, -len(rest) % DIMENSIONS)).reshape(-1, DIMENSIONS)]).astype(np.float64)


def _set_vectors(net: Network, rows: np.ndarray) -> None:
    """The reverse, in place."""
    net.embedding[:] = rows[: len(net.embedding)]
    rest, at = rows[len(net.embedding) :].ravel(), 0
    for x in (*net.taps, *net.bias, net.out):
        x[:] = rest[at : at + x.size].reshape(x.shape)
        at += x.size
    net.out_bias = float(rest[at])


def _aside(keys) -> np.ndarray:
    """The fifth of the texts that thresholds are found on."""
    return np.array([xxhash.xxh3_64_intdigest(str(k)) % 5 == 0 for k in keys], bool)


def passed(rows: DataFrame, all_: Descent, judge: Descent, weights: tuple[float, float]) -> None:
    """Has both networks learn from all rows (k, t, y), the judge but for those aside: each task descends over its own texts,
    and each row of weights moves by the mean of what the tasks that changed it did. Only sums reach the driver."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((all_, judge))
    columns = [f"c{k}" for k in range(DIMENSIONS)]

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = copy.deepcopy(sent.value)
        for frame in frames:
            texts, y = frame["t"].tolist(), frame["y"].to_numpy()
            blank = max(1, len(texts) // 50)
            ids, table = numbered([*texts, *[""] * blank])
            y, aside = np.append(y, np.zeros(blank, y.dtype)), np.append(_aside(frame["k"]), np.zeros(blank, bool))
            weight = np.where(y == 1, weights[1], weights[0])
            for one, part in zip(own, (np.arange(len(y)), np.flatnonzero(~aside)), strict=True):
                one.epoch([ids[k] for k in part.tolist()], table, y[part], weight[part])
            common.trim()
        for n, (one, before) in enumerate(zip(own, sent.value, strict=True)):
            change = _vectors(one.net) - _vectors(before.net)
            at = np.flatnonzero(change.any(axis=1))
            if len(at):
                yield pd.DataFrame(change[at], columns=columns).assign(net=n, at=at)

    kinds = ", ".join(f"{c} double" for c in columns)
    moved = rows.mapInPandas(learn, f"{kinds}, net int, at int").groupBy("net", "at").agg(*[F.avg(c).alias(c) for c in columns])
    frame = moved.toArrow().to_pandas()
    for n, one in enumerate((all_, judge)):
        own, vectors = frame[frame["net"] == n], _vectors(one.net)
        vectors[own["at"].to_numpy()] += own[columns].to_numpy()
        _set_vectors(one.net, vectors)


#: Steps that scores are counted in.
STEPS = 1 << 14


def counted(rows: DataFrame, net: Network, aside: bool) -> pd.DataFrame:
    """(g, bin, n, hits): of all rows (k, t, y), or all aside, how many texts of a group have a score in a step, and how many of
    them are toxic."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame[_aside(frame["k"])] if aside else frame
            if len(own):
                texts = own["t"].tolist()
                at = np.minimum(sent.value.raw(texts) * STEPS, STEPS - 1).astype(np.int32)
                yield pd.DataFrame({"g": sent.value.groups(texts), "bin": at, "n": 1, "hits": own["y"].to_numpy()}).groupby(["g", "bin"], as_index=False).sum()
            common.trim()

    sums = rows.mapInPandas(count, "g string, bin int, n long, hits long").groupBy("g", "bin")
    return sums.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow().to_pandas()


def threshold(p: np.ndarray, labels: np.ndarray, n: np.ndarray | None = None, close: float = 0.99) -> float:
    """With n, a score stands for so many texts, of which labels says how many are toxic. Of the scores midway between two neighbours that part the kinds nearly best by F1, the one nearest to a half:
    few labels leave the best one itself to chance."""
    order = np.argsort(-p, kind="stable")
    s, hit = p[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.cumsum(np.ones(len(p)) if n is None else n[order]) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    middle = (s + np.append(s[1:], 0.0)) / 2
    good = np.flatnonzero(f1 >= close * f1.max())
    # Anywhere between two scores is as good as midway.
    low, high = np.append(s[1:], 0.0)[good], s[good]
    at = np.where((low < 0.5) & (0.5 <= high), 0.5, middle[good])
    return float(np.clip(at[np.abs(at - 0.5).argmin()], 1e-4, 1 - 1e-4))


def train(
    docs: DataFrame, labels: DataFrame, languages: language.LanguageModel, key: str = "doc_id", text: str = "text",
    label: str = "toxic", sample: int = SAMPLE, least: int = 20,
) -> Network | None:
    """A network from all labelled texts; None without both kinds.

    Up to `sample` texts of each kind are learnt on the driver. If there are more, networks start from about so many, and a
    pass over all labelled texts follows. Thresholds are those of a network that has not seen a fifth of them, on all of that
    fifth; the one returned has seen all. A group with fewer than `least` toxic ones in that fifth takes the common threshold.
    """
    marks = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).filter("y in (0, 1) and k is not null")
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    parts = [common.sampled(marks.filter(F.col("y") == y), F.col("k"), n, sample, 3) for y, n in sorted(counts.items())]
    counts = {int(y): n for y, n in counts.items()}
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # about 2 x sample rows
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("t is not null")
    frame = rows.join(picked, "k").toPandas().sort_values(["k", "y"], kind="stable")
    if frame["y"].nunique() < 2:
        return None
    texts, y = frame["t"].tolist(), frame["y"].to_numpy()
    aside, more = _aside(frame["k"]), any(n > sample for n in counts.values())
    epochs = {"epochs": 4} if more else {}
    both = all(len(np.unique(y[part])) == 2 for part in (aside, ~aside))
    whole = descended(texts, y, **epochs)
    judge = whole  # too few labels to keep any aside
    if both:
        judge = descended([t for t, a in zip(texts, aside, strict=True) if not a], y[~aside], **epochs)
    whole.net.languages = judge.net.languages = languages
    if more:
        common.bounded_batches(docs.sparkSession)
        # Few bytes a label: measured, as larger tables are shuffled.
        known = F.broadcast(marks) if sum(counts.values()) * MARK_BYTES <= BROADCAST_BYTES else marks
        every = rows.join(known, "k").select("k", "t", F.col("y").cast("int").alias("y"))
        half = sum(counts.values()) / 2
        passed(every, whole, judge if both else copy.deepcopy(whole), (half / counts[0], half / counts[1]))
        seen = counted(every, judge.net, both)
        p, hits, n, groups = (seen["bin"].to_numpy() + 0.5) / STEPS, seen["hits"].to_numpy(), seen["n"].to_numpy(), seen["g"].to_numpy()
    else:
        if not both:
            aside[:] = True
        own = [t for t, a in zip(texts, aside, strict=True) if a]
        p, hits, groups = judge.net.raw(own), y[aside], whole.net.groups(own)
        n = np.ones(len(p))
    net = whole.net
    net.thresholds = {"": threshold(p, hits, n)}
    for g in set(groups):
        at = groups == g
        if hits[at].sum() >= least and (n[at] - hits[at]).sum() >= least:
            net.thresholds[g] = threshold(p[at], hits[at], n[at])
    return net


def score(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with score and predicted; other columns stay, old ones of these names are replaced."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    own = [F.col(f"`{c}`") for c in names]
    if net is None:
        return docs.select(*own, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    common.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        common.trim()
        return pd.Series(np.concatenate([sent.value.scores(texts.iloc[at : at + 500].tolist()) for at in range(0, len(texts), 500)] or [np.zeros(0)]))

    scored = docs.select(*own, toxic(F.col(f"`{text}`")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled ones that are not held out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    seen = docs.filter(~common.held_out(F.col("doc_id")))
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~common.held_out(F.col("doc_id")))
    languages = language.train(seen, sample_per_language=None)
    net = train(seen, labels, languages)
    return score(docs.select("doc_id", "text"), net).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
