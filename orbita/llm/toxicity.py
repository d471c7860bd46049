"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two words is the normalised gap-weighted kernel of Lodhi et al.:
common subsequences of three characters, each weighed by decay ** span, with
spans up to ``SPAN`` characters; so letters inserted into an insult, or left
out of it, cost a little and no more.  Words stand between end marks, without the
characters that aren't letters; letters set apart by spaces are joined.

Landmarks are words of the training sample: those most typical for texts
labelled toxic, and common ones of the others.  Words of sentences from
training texts are mapped by K ** -1/2 of the landmarks and a squared-hinge SVM
is fitted, multiple-instance fashion: a toxic text needs one toxic word; which
ones these are is decided again after each fit.  As the map and the SVM are
linear in the kernel's feature space, they fold into one weight for each
subsequence, exactly; that vector is what executors get (a fixed size).
Logistic regression on the margins of a text's four worst words, wherever
they stand, gives its score.

Labels are learnt only from rows with crc32(doc_id) mod 5 != 0, of these a
bounded sample: ``most_toxic`` and ``most_clean`` texts of at most ``most_chars``
characters, first by hash of id, read in one task that returns the model.
Labels, language, source and id are no inputs of a score.

The labels are labels of texts, so what the SVM is fitted on are the words of
labelled texts, not sentences as they stand; a sentence counts by its worst words.

Defined results: null text is empty; a text without words scores as the least
toxic; without labels of both kinds every score is 0; null or repeated labels:
nulls are ignored, any 1 counts as toxic; rows repeated are scored each; equal
texts score alike; texts of any length are scored whole, a word of more than
``LONGEST`` letters by overlapping parts; empty tables give no rows; other columns
are ignored (or kept as they are, by the filter), whatever their names.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, DECAY, LONGEST = 7, 0.6, 24
FOLDS, MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 5, 1500, 3000, 50_000
LANDMARKS, CACHED, LOW, WORST = 96, 300_000, -9.0, 4
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíîïñóòôöõøœúùûüýÿßœ"
SIZE = 64  # alphabet: end marks, the letters above, the rest hashed
APART = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
OTHERS = re.compile(r"[\W\d_]+")


def plain(token: str) -> str:
    return OTHERS.sub("", token.lower())


def tokens(text: str) -> set[str]:
    out = set(text.split())
    if APART.search(text):
        out.update(m[0].replace(" ", "") for m in APART.finditer(text))
    return out


def windows(word: str) -> list[str]:
    """A word, or overlapping parts of one that is very long."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


_CODE = np.zeros(0x250, np.int32)
_CODE[:] = np.arange(0x250) % 4 + 60
for _i, _c in enumerate(dict.fromkeys(LETTERS)):
    _CODE[ord(_c)] = _i + 2

_TRIPLES: dict[int, tuple] = {}


def _triples(n: int) -> tuple:
    if n not in _TRIPLES:
        at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))])
        w = DECAY ** (at[:, 2] - at[:, 0] - 2)
        _TRIPLES[n] = (*np.ascontiguousarray(at.T), (w / np.sqrt((w**2).sum())).astype(np.float32))
    return _TRIPLES[n]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For words of equal length: codes of all subsequence occurrences, and their weights, scaled to norm one."""
    n = len(words[0]) + 2
    raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n - 2)
    codes = np.zeros((len(words), n), np.int32)
    codes[:, 1:-1] = np.where(raw < 0x250, _CODE[np.minimum(raw, 0x24F)], raw % 4 + 60)
    codes[:, -1] = 1
    i, j, k, weight = _triples(n)
    return (codes[:, i] * SIZE + codes[:, j]) * SIZE + codes[:, k], weight


def by_length(words: list[str], block: int = 512):
    """Indices and words in blocks of equal length."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for own in groups.values():
        for at in range(0, len(own), block):
            yield own[at : at + block], [words[i] for i in own[at : at + block]]


def margins(words: list[str], folded: np.ndarray, bias: float) -> np.ndarray:
    """SVM margin of each word (empty: LOW)."""
    out = np.full(len(words), LOW)
    parts = [(i, p) for i, w in enumerate(words) if w for p in windows(w)]
    for at, some in by_length([p for _, p in parts]):
        codes, weights = subsequences(some)
        found = folded[codes] @ weights + bias
        np.maximum.at(out, [parts[k][0] for k in at], found)
    return out


class Nystrom:
    """Kernel map onto landmarks: subsequence codes -> rows of ``lead``; row 0 is what no landmark has."""

    def __init__(self, marks: list[str]):
        pairs = [(at, *subsequences(some)) for at, some in by_length(marks)]
        used = np.unique(np.concatenate([codes.ravel() for _, codes, _ in pairs]))
        self.slot = np.zeros(SIZE**3, np.int32)
        self.slot[used] = np.arange(1, len(used) + 1)
        v = np.zeros((len(marks), len(used) + 1))
        for at, codes, weights in pairs:
            np.add.at(v, (np.array(at)[:, None], self.slot[codes]), weights[None, :].astype(float))
        values, vectors = np.linalg.eigh(v @ v.T)
        keep = values > 1e-4
        self.lead = v.T @ (vectors[:, keep] / np.sqrt(values[keep]))  # K ** -1/2 in its eigenvectors
        self.lead[0] = 0
        self.known: dict[str, np.ndarray] = {}

    def features(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        for at, some in by_length(new, 64):
            codes, weights = subsequences(some)
            x = np.einsum("wsf,s->wf", self.lead[self.slot[codes]], weights)
            self.known.update((new[i], y) for i, y in zip(at, x, strict=True))
        return np.array([self.known[w] for w in words])

    def folded(self, w: np.ndarray) -> np.ndarray:
        return (self.lead @ w)[self.slot].astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Squared hinge with a bias in the last place, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = ridge @ w - 2 * x[on].T @ (cost[on] * y[on] * gap[on])
        step = np.linalg.solve(ridge + 2 * (x[on].T * cost[on]) @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of ridge logistic regression, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(x.shape[1]), np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(ridge + (x.T * (p * (1 - p) + 1e-9)) @ x, ridge @ w + x.T @ (p - y))
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: Iterable[tuple[str, int]]) -> dict | None:
    """(text, label) rows -> the folded weights, bias and logistic map; None without both labels.

    Texts are read once, one after the other; what stays of each is the numbers of its words.
    """
    number: dict[str, int] = {}
    bags, labels = [], []
    for text, label in rows:
        own = sorted({w for t in tokens(text) for w in windows(plain(t)) if w})
        bags.append(np.array(sorted(number.setdefault(w, len(number)) for w in own), np.int32))
        labels.append(label)
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return None
    words = list(number)
    count = lambda some: np.bincount(np.concatenate([np.empty(0, np.int32), *some]), minlength=len(words)).astype(float)
    bad, good = count([b for b, lab in zip(bags, labels, strict=True) if lab]), count([b for b, lab in zip(bags, labels, strict=True) if not lab])
    n_bad, n_good = float(y.sum()), float(len(y) - y.sum())
    share_bad, share_good = bad / n_bad, good / n_good
    p = (bad + good) / (n_bad + n_good)

    def part(k: np.ndarray, n: float) -> np.ndarray:
        """Log-likelihood ratio of k of n texts against the common share p."""
        rest = np.where((k < n) & (p < 1), (n - k) * np.log(np.maximum(n - k, 1e-9) / n / np.maximum(1 - p, 1e-12)), 0)
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / n / np.maximum(p, 1e-12)), 0) + rest

    rank = (part(bad, n_bad) + part(good, n_good)) * np.where(share_bad > share_good, 1, -1)
    name = {i: w for w, i in number.items()}
    top = sorted(np.flatnonzero((bad > 0) & (rank > 2) & (share_bad > 4 * share_good)).tolist(), key=lambda i: (-rank[i], name[i]))
    if not top:
        return None
    usual = sorted(np.flatnonzero(good > 0).tolist(), key=lambda i: (-good[i], name[i]))
    step = max(1, len(usual) // (LANDMARKS * 20))
    marks = list(dict.fromkeys(top[:LANDMARKS] + usual[: LANDMARKS // 3] + usual[LANDMARKS // 3 :: step * 30][: LANDMARKS - LANDMARKS // 3]))
    space = Nystrom([name[i] for i in marks])
    positive = set(top[: 4 * LANDMARKS])
    negative = usual[:2000] + usual[2000 :: max(1, len(usual) // 8000)]
    for _ in range(4):
        some = sorted(positive) + [i for i in negative if i not in positive]
        x = space.features([name[i] for i in some])
        sign = np.array([1.0] * len(positive) + [-1.0] * (len(some) - len(positive)))
        size = 10 * np.sqrt(1 + np.where(sign > 0, bad[some], good[some]))
        size[sign > 0] *= size[sign < 0].sum() / size[sign > 0].sum() / 2
        w = svm(x, sign, size)
        folded, bias = space.folded(w[:-1]), float(w[-1])
        found = margins(words, folded, bias)
        # each toxic text shows its worst words; words of clean texts are innocent, the worst ones are added
        limit = np.quantile([found[b].max(initial=LOW) for b, lab in zip(bags, labels, strict=True) if not lab], 0.98)
        seen = np.zeros(len(words), bool)
        seen[np.concatenate([b for b, lab in zip(bags, labels, strict=True) if lab])] = True
        likely = np.flatnonzero(seen & (found > max(limit, 0.0)) & (share_bad > 4 * share_good)).tolist()
        positive = set(likely) | set(top[: 4 * LANDMARKS])
        hard = sorted((i for i in np.flatnonzero((good > 0) & (found > -0.5)).tolist() if i not in positive), key=lambda i: (-found[i], name[i]))[:3000]
        negative = list(dict.fromkeys(negative + hard))
    worst = np.array([worst_words(found[b].tolist()) for b in bags])
    return {"folded": folded, "bias": bias, "map": logistic(worst, y.astype(float))}


def worst_words(found: list[float]) -> list[float]:
    """The margins of a text's worst words, the worst first."""
    return [min(2.0, max(-3.0, x)) for x in nlargest(WORST, found)] + [-3.0] * (WORST - min(WORST, len(found)))


class Scorer:
    """Scores of texts; margins of tokens seen lately are kept."""

    def __init__(self, model: dict | None):
        self.model, self.known, self.older = model, {}, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        bags = [tokens(t) for t in texts]
        known, old = self.known, self.older
        if new := [t for t in set().union(*bags) if t not in known]:
            seen = [t for t in new if t in old]
            known.update((t, old[t]) for t in seen)
            fresh = [t for t in new if t not in old]
            words = [plain(t) for t in fresh]
            each = list(dict.fromkeys(words))
            margin = dict(zip(each, margins(each, self.model["folded"], self.model["bias"]).tolist(), strict=True))
            known.update((t, margin[w]) for t, w in zip(fresh, words, strict=True))
        worst = np.array([worst_words(list(map(known.__getitem__, b))) for b in bags]).reshape(-1, WORST)
        w = self.model["map"]
        return 1 / (1 + np.exp(-np.clip(worst @ w[:-1] + w[-1], -30, 30)))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS) -> dict | None:
    """Train in one task on a bounded sample of labelled, not held-out rows: the first by hash of id.

    Of these ids, each gives one text (the least in order, if it has several) of at
    most ``most_chars`` characters; longer ones are not learnt from.  What comes back
    to the driver is the model, about one MB.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    pick = lambda toxic, most: known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = pick(1, most_toxic).unionByName(pick(0, most_clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.char_length("text") <= most_chars).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))

    def run(batches):
        model = train((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    one = rows.repartition(1).sortWithinPartitions("text", "toxic").select("text", "toxic")
    row = one.mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def scored(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, **bounds)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_scores(docs: DataFrame, model: dict | None, drop_from: float | None = None) -> DataFrame:
    """doc_id and score; or, with drop_from, the rows of lower score, unchanged."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    cached: list[Scorer] = []
    at = docs.columns.index("text")

    def run(batches):
        if not cached:
            cached.append(Scorer(shipped.value))
        for b in batches:
            for i in range(0, b.num_rows, 128):
                some = b.slice(i, 128)
                s = cached[0].scores([t or "" for t in some.column(at).to_pylist()])
                if drop_from is None:
                    yield pa.record_batch([some.column(0), pa.array(s)], names=["doc_id", "score"])
                else:
                    yield some.filter(pa.array(s < drop_from))

    return docs.mapInArrow(run, "doc_id long, score double" if drop_from is None else docs.schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """documents without those that the method rejects."""
    return with_scores(docs, fit(docs, labels, **bounds), threshold)
