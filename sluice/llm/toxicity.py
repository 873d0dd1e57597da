"""Operator 5: toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words counts the subsequences of three letters they share, each damped by the stretch it spans,
and is normalised; letters put in between or left out change it little. The kernel against landmarks (strings from
labelled texts), whitened, is a word's feature vector (Nyström). The machine is trained on labelled sentences: of
each labelled text the sentence that the machine finds worst stands for the text, by its worst word, and a
squared-hinge SVM separates the sentences of toxic texts from those of others; the choice of sentences and the fit
alternate for ``ROUNDS``. The first machine, from which the choice starts, separates the landmarks themselves. As
subsequences of three letters can be listed, the fitted machine is kept as one weight for each of them, and a word
costs a few look-ups. A text's score comes from its highest word and the number of words beyond the margin against
its length, calibrated by logistic regression on labelled texts that took no part in the training.

Fitting uses a bounded sample of labelled rows: ``sample`` rows of each label, in order of a hash of doc_id. All that
the driver holds is bounded by it: at most ``2 * sample`` words of either side in a round, and the landmarks.

Cases: null and empty texts get the score that belongs to no words; words without three letters count as
harmless; single letters in a row ("i d i o t") are also read as one word; letters are lower-cased and other
characters inside a word passed over; null labels do not count, and labels of one class only, or without a word that
tells the classes apart, give nothing to learn (score 0 for all); rows are judged one by one; other columns are passed along, and columns
named score or predicted replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

ALPHABET, ORDER, DECAY, LONGEST = 64, 3, 0.8, 20
SAMPLE, LANDMARKS, ROUNDS = 6000, 512, 2
#: Likelihood ratio (G squared) of a word's counts in toxic and other texts, from which it may be a toxic landmark.
EVIDENCE = 24.0
#: Word scores kept for each of two generations in a Python worker, of chunks of at most so many characters.
KEEP, KEEP_LETTERS = 400_000, 64
_SENTENCE = re.compile(r"[.!?\u3002\uff01\uff1f]+(?=\s|$)|\n+")
_APART = re.compile(r"(?:(?<=\s)|^)[^\W\d_](?:[ .*_-][^\W\d_]){2,}(?=\s|$|[.,!?])")
_COMBOS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def clean(chunk: str) -> str:
    return chunk if chunk.isalpha() else "".join(filter(str.isalpha, chunk))


def pieces(word: str) -> list[str]:
    """A long word as overlapping stretches."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def apart(text: str) -> list[str]:
    """Words written as single letters in a row."""
    return [clean(m.group()) for m in _APART.finditer(text)]


def _combos(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _COMBOS:
        at = np.asarray(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
        _COMBOS[n] = (at, DECAY ** (at[:, -1] - at[:, 0] + 1.0) if at.size else np.zeros(0))
    return _COMBOS[n]


def _codes(words: list[str], n: int) -> np.ndarray:
    """A row of letter codes for each word of n letters, between marks for its begin and end."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.int64)
    return np.pad(np.where((c >= 97) & (c <= 122), c - 96, 27 + c % 36), ((0, 0), (1, 1)), constant_values=((0, 0), (0, ALPHABET - 1)))


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, keys, damping, norms) of words of equal length: keys of all their subsequences, a row for each word.

    A subsequence may occur more than once. The norm is that of the summed dampings: K(w, w) by running sums over
    the pairs of places with equal letters.
    """
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, every in by.items():
        if n < ORDER:
            continue
        at, damp = _combos(n + 2)
        step = max(1, 2_000_000 // damp.size)
        up = DECAY ** np.arange(n + 2.0)
        for lo in range(0, len(every), step):
            rows = every[lo : lo + step]
            c = _codes([words[i] for i in rows], n)
            keys = (c[:, at[:, 0]] * ALPHABET + c[:, at[:, 1]]) * ALPHABET + c[:, at[:, 2]]
            same = (c[:, :, None] == c[:, None, :]).astype(float)
            run = same / (up[:, None] * up[None, :])
            for _ in range(ORDER - 1):
                before = np.zeros_like(run)
                before[:, 1:, 1:] = run.cumsum(axis=1).cumsum(axis=2)[:, :-1, :-1]
                run = same * before
            norms = np.sqrt((run * (up[:, None] * up[None, :])).sum(axis=(1, 2))) * DECAY
            yield np.asarray(rows), keys, damp, norms


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of words against landmarks."""
    listed = list(subsequences(landmarks))
    used = np.unique(np.concatenate([keys.ravel() for _, keys, _, _ in listed] or [np.zeros(0, np.int64)]))
    place = np.zeros(ALPHABET**ORDER, np.int32)  # 0: in no landmark
    place[used] = np.arange(1, used.size + 1)
    table = np.zeros((used.size + 1, len(landmarks)), np.float32)
    for rows, keys, damp, norms in listed:
        for r, k, norm in zip(rows, keys, norms):
            np.add.at(table, (place[k], r), damp / norm)
    out = np.zeros((len(words), len(landmarks)))
    for rows, keys, damp, norms in subsequences(words):
        for r, k, norm in zip(rows, place[keys], norms):
            out[r] = damp[k > 0] @ table[k[k > 0]] / norm
    return out


def fit_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.03, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps over the rows inside the margin."""
    x, w = np.c_[z, np.ones(len(z))], np.zeros(z.shape[1] + 1)
    eye = np.eye(w.size) * ridge
    eye[-1, -1] = 1e-9
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a = x[inside]
        new = np.linalg.solve(eye + (a * cost[inside, None]).T @ a, (a * cost[inside, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression with an intercept (last), by Newton steps that are halved until the loss falls."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)

    def loss(v: np.ndarray) -> float:
        m = x @ v
        return float((np.logaddexp(0, m) - y * m).sum() + ridge * v @ v / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(w.size), x.T @ (y - p) - ridge * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), min(self.bias, -1.0))
        for rows, keys, damp, norms in subsequences(words):
            out[rows] = self.table[keys] @ damp.astype(np.float32) / norms + self.bias
        return out

    def scorer(self) -> Scorer:
        """One for each worker process, as long as it holds the model."""
        if "_scorer" not in self.__dict__:
            self._scorer = Scorer(self)
        return self._scorer

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scorer"}


class Scorer:
    """Text features under a model, with the scores of words kept."""

    def __init__(self, model: Model):
        self.model, self.new, self.old, self.passing = model, {}, {}, {}

    def learn(self, chunks: set[str]) -> None:
        """Scores of chunks: that of the worst piece of their letters. Long chunks are kept for one call only."""
        self.passing = {}
        if len(self.new) > KEEP:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        unknown = []
        for c in chunks:
            if c not in new:
                if c in old:
                    new[c] = old[c]
                else:
                    unknown.append((c, clean(c)))
        words = list({w for c, w in unknown if w not in new and w not in old})
        parts = [(w, p) for w in words for p in pieces(w)]
        best: dict[str, float] = {}
        for (w, _), s in zip(parts, self.model.word_scores([p for _, p in parts]).tolist()):
            if s > best.get(w, -np.inf):
                best[w] = s
        for c, w in unknown:
            s = best[w] if w in best else new[w] if w in new else old[w]
            (new if len(c) <= KEEP_LETTERS else self.passing)[c] = s
            if len(w) <= KEEP_LETTERS:
                new[w] = s

    def scores(self, chunks: set[str] | list[str]) -> np.ndarray:
        new, passing = self.new, self.passing
        return np.fromiter((new[c] if c in new else passing[c] for c in chunks), float, len(chunks))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Highest word score; log of the words beyond the margin, plain and times the log of all words."""
        lists = []
        for t in texts:
            low = (t or "").lower()
            lists.append(set(low.split()).union(apart(low)))
        self.learn(set().union(*lists))
        out = np.empty((len(texts), 3))
        for i, chunks in enumerate(lists):
            s = self.scores(chunks)
            hits = np.log1p((s > 0).sum())
            out[i] = (s.max(), hits, hits * np.log1p(s.size)) if s.size else (-2.0, 0.0, 0.0)
        out[:, 0] = np.clip(out[:, 0], -2, 2)
        return out

    def sentences(self, text: str | None) -> list[tuple[str, float]]:
        """The worst word of each sentence of a text (the first of equals by letters), and its score."""
        lists = [list(set(s.split()).union(apart(s))) for s in _SENTENCE.split((text or "").lower())]
        self.learn(set().union(*lists))
        out = []
        for chunks in lists:
            s = self.scores(chunks)
            if s.size:
                word = clean(min(chunks[i] for i in np.flatnonzero(s == s.max())))
                long = pieces(word)
                out.append((word if len(long) == 1 else long[int(self.model.word_scores(long).argmax())], float(s.max())))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.calibration.size:
            return np.zeros(len(texts))
        w = self.model.calibration
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ w[:-1] + w[-1], -30, 30)))


def _groups(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of bounded length together, with the place of the first."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def _machine(landmarks: list[str], words: list[str], y: np.ndarray, cost: np.ndarray) -> Model:
    """An SVM over words by their Nyström features, as a weight for each subsequence."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    cost = np.where(y > 0, cost / cost[y > 0].sum(), cost / cost[y < 0].sum()) * len(words) / 2
    w, bias = fit_svm(kernel(words, landmarks) @ whiten, y, cost)
    beta, table = whiten @ w, np.zeros(ALPHABET**ORDER, np.float32)
    for at, keys, damp, norms in subsequences(landmarks):
        np.add.at(table, keys.ravel(), (damp[None, :] * (beta[at] / norms)[:, None]).ravel().astype(np.float32))
    return Model(table, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), at most ``sample`` labelled rows of each class."""
    small_batches(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marked = marked.withColumn("h", F.xxhash64("doc_id"))
    chosen = marked.where("toxic = 1").orderBy("h", "doc_id").limit(sample).union(marked.where("toxic = 0").orderBy("h", "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # 2 * sample rows of three numbers
    rows = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), (F.col("h").bitwiseAND(F.lit(3)) == 0).alias("check"))
    rows = written(rows, "toxicity-sample")  # read in every round

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(out: set[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["word", "toxic", "doc", "around"])

        out: set[tuple] = set()
        for b in batches:
            for doc, t, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                chunks = ["", *(t.as_py() or "").lower().split(), ""]
                for before, c, after in zip(chunks, chunks[1:], chunks[2:]):
                    around = crc32(f"{before} {after}".encode("utf-8", "surrogatepass"))
                    out.update((p, y, doc, around) for p in pieces(clean(c)) if len(p) >= ORDER)
                    if len(out) >= 200_000:
                        yield listed(out)
                        out = set()
        yield listed(out)

    seen = rows.where("not check").select("doc_id", "text", "toxic").mapInArrow(words, "word string, toxic int, doc long, around long")
    # Copies of a text repeat its words in equal surroundings, and a text may repeat a word: the smaller number counts.
    times = seen.groupBy("word", "toxic").agg(F.least(F.count_distinct("doc"), F.count_distinct("around")).alias("n"))
    counts = times.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("fine"))
    n = {r[0]: r[1] for r in rows.where("not check").groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    counts = written(counts, "toxic-words")
    lift = F.log((F.col("bad") + 0.1) / n[1]) - F.log((F.col("fine") + 0.6) / n[0])
    share = n[1] / (n[0] + n[1])
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("bad") + F.col("fine")) * p))).otherwise(0.0)
    strong = counts.where(lift > 1.5).withColumn("s", 2 * (part("bad", share) + part("fine", 1 - share))).where(F.col("s") >= EVIDENCE)
    marks = strong.orderBy(F.desc("s"), "word").limit(landmarks // 2).collect()
    others = counts.where((F.col("fine") > 0) & (lift < 0.7))
    common = others.orderBy(F.desc("fine"), "word").limit(landmarks // 4).collect()
    rare = others.orderBy(F.xxhash64("word"), "word").limit(landmarks).collect()
    bad = {r["word"]: float(r["bad"]) for r in marks}
    fine = list(dict.fromkeys([*[r["word"] for r in common], *[r["word"] for r in rare]]))[: landmarks - len(bad)]
    if not bad or not fine:
        return Model()
    strings = [*bad, *fine]
    words = dict.fromkeys(fine, (-1.0, 1.0)) | {w: (1.0, c) for w, c in bad.items()}
    model = _machine(strings, list(words), *np.asarray(list(words.values())).T)
    train, seen_bad, seen_fine = rows.where("not check").select("text", "toxic"), dict(bad), dict.fromkeys(fine, 1.0)
    for _ in range(rounds):

        def choose(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            scorer = model.scorer()
            for b in batches:
                found = []
                for t, y in zip(b.column(0), b.column(1).to_pylist()):
                    found += [(w, y, s) for w, s in scorer.sentences(t.as_py()) if s > (0.5 if y else -1)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.float64())], names=["word", "toxic", "score"])

        counted = written(train.mapInArrow(choose, "word string, toxic int, score double").groupBy("word", "toxic").agg(F.count("*").alias("n")), "toxicity-sentences")
        side = lambda y: counted.where((F.col("toxic") == y) & (F.col("n") > y)).orderBy(F.xxhash64("word"), "word").limit(2 * sample).collect()
        for held, y in ((seen_bad, 1), (seen_fine, 0)):
            for r in side(y):
                held[r["word"]] = max(held.get(r["word"], 0.0), float(r["n"]))
        pairs = [(w, 1.0, c) for w, c in sorted(seen_bad.items())] + [(w, -1.0, c) for w, c in sorted(seen_fine.items())]
        model = _machine(strings, [w for w, _, _ in pairs], np.asarray([y for _, y, _ in pairs]), np.asarray([c for _, _, c in pairs]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            f = np.concatenate([scorer.features(t) for _, t in _groups(b.column(0).to_pylist())]) if b.num_rows else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([pa.array(f[:, k]) for k in range(3)] + [b.column(1)], names=["a", "b", "c", "toxic"])

    got = rows.where("check").select("text", "toxic").mapInArrow(look, "a double, b double, c double, toxic int").toArrow()  # a part of the sample
    x, t = np.c_[got.column("a").to_numpy(), got.column("b").to_numpy(), got.column("c").to_numpy()], got.column("toxic").to_numpy().astype(float)
    if not t.size or t.min() == t.max():
        model.calibration = np.asarray([2.0, 0.0, 0.0, 0.0])
        return model
    # The sample holds the classes evenly; the prior is that of all labelled rows.
    labelled = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    w = fit_logistic(x, t)
    prior, here = labelled[1] / (labelled[0] + labelled[1]), t.mean()
    w[-1] += np.log(prior / (1 - prior)) - np.log(here / (1 - here))
    model.calibration = w
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on)."""
    small_batches(docs.sparkSession)
    base = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ALPHABET ** ORDER weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            s = np.concatenate([scorer.score(t) for _, t in _groups(b.column("text").to_pylist())]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return base.mapInArrow(judge, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
