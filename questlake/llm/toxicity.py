"""Toxicity by maximum-scoring segments.

Token scores are log-odds ratios between toxic and clean documents, smoothed by an informative Dirichlet prior (document
frequencies of both classes together) and kept where a likelihood-ratio test is significant among that many words; a drift makes
the expected score of clean text negative. A linear scan finds all maximal scoring segments of a document; the best one's score is calibrated as an extreme
value, lambda * S - ln(K n) (lambda solves the moment equation over clean tokens, K is fitted on clean maxima), and a logistic
curve over that figure and the count of significant segments gives the score.

The model is fitted on at most ``sample`` labelled rows of ``sample_bytes`` together, taken by a hash of the id; all their clean texts
calibrate it. Scoring covers whole texts.

Defined cases: null and empty texts have no segment and get the base score; labels that disagree count as toxic; null labels are
ignored; without labels of both classes each score is the training rate of toxic rows (0 if there are none); rows of one id share
its label, and exact copies among them train once; very long texts are scored whole, but train only if they fit the bound; an empty
table gives no rows; a column named ``tox_score`` is replaced, other extra columns are kept (or only those in ``keep``).
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questlake.llm.common import add_columns, utf8_rows

#: Bounds of the rows that the model is fitted on: their number, and the bytes of their texts together.
SAMPLE = 6000
SAMPLE_BYTES = 24 << 20
THRESHOLD = 0.3
_SPACED = string.punctuation + string.digits + string.whitespace
_TABLE = bytes.maketrans((string.ascii_uppercase + _SPACED).encode(), (string.ascii_lowercase + " " * len(_SPACED)).encode())


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters (ASCII punctuation, digits and white space split)."""
    return text.translate(_TABLE).split()


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, score), in linear time."""
    found: list[list] = []  # start, end, sum before, sum up to the end
    total = 0.0
    for at, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [at, at + 1, before, total]
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
        else:
            new.append(-1)
        found.append(new)
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    drift: float = 0.25
    lam: float = 1.0
    ln_k: float = 0.0
    weights: tuple[float, float, float] = (0.0, 0.0, -50.0)

    def spans(self, text: bytes) -> tuple[list[tuple[int, int, float]], int]:
        """Positive maximal segments in token positions, and the number of tokens."""
        words = tokens(text)
        get = self.scores.get
        return self.placed([(i, s) for i, s in enumerate(map(get, words)) if s is not None]), len(words)

    def placed(self, hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
        """The segments of scored tokens (position, score); the drift counts for those between them."""
        if not any(s > 0 for _, s in hits):
            return []
        packed, places, last = [], [], 0
        for i, s in hits:
            if i > last:
                packed.append(-self.drift * (i - last))
                places.append((last, i))
            packed.append(s - self.drift)
            places.append((i, i + 1))
            last = i + 1
        return [(places[a][0], places[b - 1][1], s) for a, b, s in segments(packed)]

    def features(self, text: bytes) -> tuple[float, float]:
        """Logs of the best segment as an extreme value and of the number of segments that are significant at 0.05."""
        found, n = self.spans(text)
        if not found:
            return 0.0, 0.0
        norm = [self.lam * s - self.ln_k - math.log(n) for *_, s in found]
        return math.log1p(max(0.0, max(norm))), math.log1p(sum(x > 2.97 for x in norm))

    def score(self, text: bytes) -> float:
        a, b = self.features(text)
        x = self.weights[0] * a + self.weights[1] * b + self.weights[2]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _lambda(values: np.ndarray) -> float:
    """The positive root of mean(exp(l * s)) = 1, for a mean below zero."""
    if not (values > 0).any():
        return 1.0
    lo, hi = 1e-6, 1.0
    while np.exp(np.minimum(hi * values, 700)).mean() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.exp(np.minimum(mid * values, 700)).mean() < 1 else (lo, mid)
    return lo


def _root_g2(a: int, n1: int, b: int, n0: int) -> float:
    """The root of the likelihood-ratio statistic of a in n1 against b in n0."""
    share = (a + b) / (n1 + n0)
    parts = ((a, n1 * share), (n1 - a, n1 * (1 - share)), (b, n0 * share), (n0 - b, n0 * (1 - share)))
    return math.sqrt(max(0.0, 2 * sum(x * math.log(x / e) for x, e in parts if x)))


def copies(texts: Iterable[np.ndarray], n_texts: int, minima: int = 8) -> list[int]:
    """A group number for each text (hashes of its tokens); texts that share one of some least hashes of their five-word shingles are of
    one group."""
    up = list(range(n_texts))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    known: dict[tuple[int, int], int] = {}
    for i, h in enumerate(texts):
        n = max(1, len(h) - 4)
        mix = np.zeros(n, np.uint64)
        for k in range(min(5, len(h))):
            mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        for k in range(minima):
            x = (mix ^ (mix >> np.uint64(29))) * np.uint64(2 * k + 0xBF58476D1CE4E5B9)
            first = known.setdefault((k, int((x ^ (x >> np.uint64(32))).min())), i)
            a, b = sorted((root(first), root(i)))
            up[b] = a
    number: dict[int, int] = {}
    return [number.setdefault(root(i), len(number)) for i in range(n_texts)]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton steps, halved until the penalised likelihood rises."""
    loss = lambda w: float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ridge * (w @ w) / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        now, rate = loss(w), 1.0
        while rate > 1e-6 and not loss(w + rate * step) < now:
            rate /= 2
        if rate <= 1e-6:
            break
        w = w + rate * step
    return w


def _words(vocabulary: list[bytes], seen: np.ndarray, sizes: np.ndarray, prior: float, drift: float, clean: list[np.ndarray]) -> Model:
    """Word scores and extreme-value parameters from document frequencies (clean, toxic) and the tokens of all clean texts."""
    model, (n0, n1), (c0, c1) = Model(drift=drift), sizes.tolist(), seen
    some = np.flatnonzero(c0 + c1 >= 3)
    z_min = math.sqrt(2 * math.log(max(2, len(some))))  # the largest z that chance gives among so many words
    score = np.zeros(len(vocabulary))
    if n0 and n1:
        for w, a, b in zip(some.tolist(), c1[some].tolist(), c0[some].tolist()):
            if _root_g2(a, n1, b, n0) >= z_min:
                alpha = prior * (a + b) / (n0 + n1)
                y1, y0, m1, m0 = a + alpha, b + alpha, n1 + prior, n0 + prior
                score[w] = model.scores[vocabulary[w]] = math.log(y1 / (m1 - y1)) - math.log(y0 / (m0 - y0))
    if (score > 0).any():
        drawn = score[np.concatenate(clean)] - drift if clean else np.zeros(0)
        model.lam = _lambda(drawn if len(drawn) else np.array([-drift]))
        best = []
        for x in clean:
            at = np.flatnonzero(score[x])
            if found := model.placed(list(zip(at.tolist(), score[x[at]].tolist()))):
                best.append(model.lam * max(s for *_, s in found) - math.log(len(x)))
        model.ln_k = float(np.mean(best or [0.0])) - 0.5772
    return model


def fit(rows: list[tuple[bytes, int]], prior: float = 20.0, drift: float = 0.25, folds: int = 5) -> Model:
    """Fit on (text, label) rows: driver-side, bounded by the sample.

    Exact and near copies count once, or each rare word of a copied text would look like evidence. The logistic curve is fitted on
    figures of texts whose group the word scores haven't seen (cross-fitting).
    """
    n1 = sum(y for _, y in rows)
    rate = n1 / len(rows) if rows else 0.0
    base = math.log(rate / (1 - rate)) if 0 < rate < 1 else (50.0 if rate else -50.0)
    if not 0 < rate < 1:
        return Model(drift=drift, weights=(0.0, 0.0, base))
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int32) for t, _ in rows]
    vocabulary = list(number)
    hashed = np.fromiter(map(zlib.crc32, vocabulary), np.uint64, len(vocabulary))
    group = copies((hashed[x] for x in ids), len(rows))
    of_group: dict[tuple[int, int], list[int]] = {}
    for i, (g, (_, y)) in enumerate(zip(group, rows)):
        of_group.setdefault((g, y), []).append(i)
    seen, sizes = np.zeros((folds, 2, len(vocabulary)), np.int64), np.zeros((folds, 2), np.int64)
    clean: list[list[np.ndarray]] = [[] for _ in range(folds)]
    for (g, y), some in of_group.items():
        seen[g % folds, y, np.unique(np.concatenate([ids[i] for i in some]))] += 1
        sizes[g % folds, y] += 1
        if not y and len(ids[some[0]]):
            clean[g % folds].append(ids[some[0]])
    x, y = [], []
    for k in range(folds):
        rest = [i for i in range(folds) if i != k]
        model = _words(vocabulary, seen[rest].sum(axis=0), sizes[rest].sum(axis=0), prior, drift, [c for i in rest for c in clean[i]])
        mine = [i for i, g in enumerate(group) if g % folds == k]
        x += [[*model.features(rows[i][0]), 1.0] for i in mine]
        y += [rows[i][1] for i in mine]
    w = _logistic(np.array(x), np.array(y, float), np.array([0.0, 0.0, base]))
    model = _words(vocabulary, seen.sum(axis=0), sizes.sum(axis=0), prior, drift, [c for part in clean for c in part])
    model.weights = tuple(float(v) for v in w)
    return model


def held_out(id_col: str = "doc_id"):
    """crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows that aren't held out: the first ``sample`` of them by a hash of the id, and of these, in that order, all whose
    texts still fit into ``sample_bytes``. Rows are chosen by figures alone; only the texts chosen come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    found = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sized = found.select("id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    taken, left = set(), sample_bytes
    for r in sized.orderBy(F.xxhash64("id"), "id", "h").limit(sample).collect():
        if (r.id, r.h) not in taken and r.n <= left:
            taken.add((r.id, r.h))
            left -= r.n
    picked = docs.sparkSession.createDataFrame(sorted(taken), "id long, h long")
    rows = found.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "h", "y", "text").collect()
    return fit([(r.text.encode(), int(r.y > 0)) for r in sorted(rows, key=lambda r: (r.id, r.h))])


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``tox_score`` (0 to 1); ``passages`` gives the significant passages themselves."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = sent.value

        def fn(batch):
            texts = utf8_rows(batch.column(batch.schema.get_field_index(text_col)))
            return [[m.score(x) for x in texts]]

        return fn

    return add_columns(docs, [text_col], [("tox_score", pa.float64(), T.DoubleType())], start, keep)


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 2.97) -> DataFrame:
    """Every significant passage: id, first token, end, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            out = []
            for i, x in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                found, n = m.spans(x)
                out += [(i, a, b, s) for a, b, s in found if m.lam * s - m.ln_k - math.log(n) > least]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["id", "start", "stop", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, start long, stop long, score double")
