"""Language identification by a byte convolutional network.

Bytes are embedded, convolved with filters of widths 2, 3, 4 and 5, rectified, max-pooled over fixed windows of 256 bytes and
classified by softmax; a document's class is the one with the highest mean probability over all its windows (weighted by
their bytes). Training is plain numpy (Adam) on windows of labelled texts.

The training rows are a bounded sample: at most about ``per_lang`` texts of each language, chosen by a hash of the id, and
``windows`` windows of each, spread over the whole text.

Defined cases: a null text or one without a letter gets ``und`` and score 0; rows without a language don't train; without any
labelled row each text is ``und``; repeated rows are classified alike; classes that tie go to the first name; very long texts are
read whole, in windows; an empty table gives no rows; columns named like the results are replaced, other extra columns are kept (or
only those in ``keep``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questlake.llm.common import add_columns, utf8_arrays

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
UND = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCNN:
    """emb: (256, d). kernels: (max width, d, filters), zero beyond each filter's width. out: (filters, classes)."""

    langs: list[str]
    emb: np.ndarray
    kernels: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, wins: np.ndarray) -> np.ndarray:
        """(n, window) bytes to (n, filters): the maximum response of each filter."""
        n, size = wins.shape
        width, d, filters = self.kernels.shape
        x = self.emb[np.concatenate([wins.reshape(-1), np.zeros(width - 1, np.uint8)])]
        cols = np.concatenate([x[k : k + n * size] for k in range(width)], axis=1)
        y = (cols @ self.kernels.reshape(width * d, filters)).reshape(n, size, filters)
        # the last positions would read into the next window
        y = y[:, : size - width + 1]
        while (m := y.shape[1]) > 1:
            half = (m + 1) // 2
            y = np.maximum(y[:, :half], y[:, m - half :])
        return np.maximum(y[:, 0] + self.bias, 0)

    def probabilities(self, wins: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(wins), 64):
            z = self.pooled(wins[at : at + 64]) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows (the last one of each padded with zeros): windows, each one's text, its bytes."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), per)
    first = np.cumsum(per) - per
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    length = np.minimum(WINDOW, offsets[1:][owner] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    wins = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start].copy()
    short = np.flatnonzero(length < WINDOW)
    wins[short] *= np.arange(WINDOW) < length[short, None]
    return wins, owner, length


def train(wins: np.ndarray, labels: np.ndarray, langs: list[str], d: int = 8, each: int = 8, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Minimise cross-entropy by Adam. Half of the windows are also shown cut short, for short texts."""
    rng = np.random.default_rng(seed)
    width, filters, c = max(WIDTHS), each * len(WIDTHS), max(1, len(langs))
    mask = np.zeros((width, 1, filters), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * each : (i + 1) * each] = 1
    p = [rng.normal(0, 0.5, (256, d)), rng.normal(0, 0.3, (width, d, filters)) * mask, np.zeros(filters), rng.normal(0, 0.3, (filters, c)), np.zeros(c)]
    p = [x.astype(np.float32) for x in p]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    freq = np.bincount(labels, minlength=c)
    weight = (len(labels) / np.maximum(1, freq * c)).astype(np.float32)
    for _ in range(epochs if len(wins) else 0):
        order = rng.permutation(len(wins))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = wins[rows].copy(), labels[rows]
            for i in np.flatnonzero(rng.random(len(rows)) < 0.5):
                x[i, int(rng.integers(12, WINDOW)) :] = 0
            n = len(x)
            e = p[0][x]
            cols = np.concatenate([e[:, k : WINDOW - width + 1 + k] for k in range(width)], axis=2)
            z = cols @ p[1].reshape(width * d, filters)
            arg = z.argmax(axis=1)
            top = np.take_along_axis(z, arg[:, None], 1)[:, 0] + p[2]
            h = np.maximum(top, 0)
            o = h @ p[3] + p[4]
            q = np.exp(o - o.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), y] -= 1
            q *= weight[y, None] / n
            gh = (q @ p[3].T) * (top > 0)
            picked = cols[np.arange(n)[:, None], arg]  # n, filters, width * d
            gk = np.einsum("nf,nfk->kf", gh, picked).reshape(width, d, filters) * mask
            back = (gh[:, :, None] * p[1].reshape(width * d, filters).T).reshape(n, filters, width, d)
            places = arg[:, :, None] + np.arange(width)
            ge = np.zeros_like(p[0])
            np.add.at(ge, x[np.arange(n)[:, None, None], places], back)
            step += 1
            for k, g in enumerate((ge, gk, gh.sum(0), h.T @ q, q.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            p[1] *= mask
    return ByteCNN(langs, *p)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, windows: int = 6, most_langs: int = 100) -> ByteCNN:
    """Train on a bounded sample of the labelled rows that aren't held out: about ``per_lang`` of each of the ``most_langs`` most frequent
    languages (ties by name), which are those that can be predicted."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_langs).collect()}
    langs = sorted(counts)
    if not langs:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), [])
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 1.3 * per_lang / counts[k]))])
    chosen = known.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).where(F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 20)) < F.element_at(share, F.col(lang_col)) * (1 << 20))
    gap = F.greatest(F.lit(1), F.floor((F.length(text_col) - WINDOW) / max(1, windows - 1)).cast("int"))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(F.col(text_col), (F.lit(1) + F.least(i * gap, F.greatest(F.lit(0), F.length(text_col) - WINDOW))).cast("int"), F.lit(WINDOW))))
    rows = chosen.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(lang_col).alias("lang"), spread.alias("w")).orderBy("h", "lang").limit(2 * per_lang * len(langs)).collect()
    at = {k: i for i, k in enumerate(langs)}
    pairs = [(w.encode()[:WINDOW], at[r.lang]) for r in rows for w in r.w]
    wins = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w, _ in pairs), np.uint8).reshape(-1, WINDOW)
    return train(wins, np.array([y for _, y in pairs], int), langs)


def threshold(docs: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bins: int = 100) -> float:
    """The score below which a prediction is more likely wrong than right, by all labelled rows that are held out (0 if there are none).

    It is the end of that run of score bins, from the least up, which holds the most wrong predictions beyond the right ones.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    rows = docs.where(held_out(id_col) & lang.isNotNull()).select(text.alias("text"), lang.alias("lang"))
    got = predicted(rows, model, keep=["lang"]).where(F.col("lang_pred") != UND)
    per = got.groupBy(F.least(F.floor(F.col("lang_score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum(F.when(F.col("lang_pred") == F.col("lang"), -1).otherwise(1)).alias("wrong"))
    wrong = np.zeros(bins, np.int64)
    for r in per.collect():  # at most a row a bin
        wrong[r.bin] = r.wrong
    sums = np.cumsum(wrong)
    best = int(sums.argmax())
    return (best + 1) / bins if sums[best] > 0 else 0.0


def predicted(docs: DataFrame, model: ByteCNN, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, from all windows of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        net = sent.value

        def fn(batch):
            col = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = utf8_arrays(col)
            wins, owner, length = windows_of(data, offsets)
            n, c = batch.num_rows, len(net.langs)
            if not c:
                return [[UND] * n, [0.0] * n]
            probs = net.probabilities(wins) * length[:, None]
            total = np.zeros((n, c))
            np.add.at(total, owner, probs)
            total /= np.maximum(1, np.diff(offsets))[:, None]
            best = total.argmax(axis=1)
            letters = [bool(_LETTER.search(bytes(data[a : min(b, a + 200)]).decode(errors="ignore")) or _LETTER.search(bytes(data[a:b]).decode())) for a, b in zip(offsets[:-1], offsets[1:])]
            return [[net.langs[k] if ok else UND for k, ok in zip(best, letters)], [min(1.0, float(total[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, letters))]]

        return fn

    return add_columns(docs, [text_col], [("lang_pred", pa.string(), T.StringType()), ("lang_score", pa.float64(), T.DoubleType())], start, keep)
