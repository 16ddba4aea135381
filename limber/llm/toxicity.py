"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters the network as the sum of what is known of it whole (a vector, if
it occurs in enough labelled documents) and of its letters (the mean of the
vectors of all its hashed letter n-grams). A run without white space of more
than ``PIECE`` letters enters as several words, pieces that overlap so that each
n-gram lies in one of them. The network reads windows of ``WINDOW``
words that overlap by half; all windows of a text are scored, and a logistic
layer over the largest, second largest and mean window score gives the text's.

The labels belong to whole documents, of which a few windows are toxic. So the
network is trained in rounds on the most telling windows of the toxic
documents: at first those with the words or letter n-grams that set toxic
documents apart, then those that the network itself scores highest. A quarter
of the sample is held back from it to fit the last layer.

The model is fitted on the driver from a sample of labelled documents that is
bounded (``SAMPLE`` of each label, picked by a hash of the id), with all their
words and windows. Scoring is one map over all documents and all their windows.

Edge cases: null and empty texts are one window without words; a null id is not
held out and never trained on; labels that are null are ignored, of several for
one id the largest counts; without labels of both kinds every score is the
share of toxic ones, or 0; a quarter of the sample without documents of both
labels fits the last layer together with the rest; an empty table gives an empty result; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limber.llm.common import text_of
from limber.llm.gru import gru, loss_gradient, pooled_logits, sigmoid

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, LETTER_DIM, ATTENTION = 8, 8, 8, 8
LETTER_ROWS, GRAM_SIZES = 8192, (3, 4, 5)
#: Longest word, and the letters that pieces of a longer one share.
PIECE, OVERLAP = 32, max(GRAM_SIZES) - 1
#: N-grams whose vectors are summed at once; bounds the arrays.
CHUNK_GRAMS = 1 << 19
#: A word gets a vector of its own if it is in so many sampled documents; all others are known by their letters.
MIN_DOCUMENTS = 4
#: Most documents of each label that the model is fitted on.
SAMPLE = 1500
ROUNDS, BATCH, RATE = 6, 64, 0.008
#: Words whose projections a task keeps; beyond it the cache starts anew.
MAX_CACHED = 300_000
FOLDS = 5


def pieces(word: str) -> list[str]:
    """The word, or its overlapping pieces if it is long."""
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - OVERLAP, PIECE - OVERLAP)]


def tokens(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    return [p for w in words for p in pieces(w)] if max(map(len, words), default=0) > PIECE else words


def word_of_token(text: str | None, place: int) -> int:
    """The number of the word that the token at ``place`` is of, 0 in a text without words."""
    at = 0
    for i, w in enumerate((text or "").lower().split()):
        at += len(pieces(w))
        if place < at:
            return i
    return 0


def bare(token: str) -> str:
    return token.strip(".,;:!?\"'()[]{}…«»“”*#$%&|") or token


def grams(word: str) -> list[int]:
    """Rows of the letter n-grams of a word, its ends marked."""
    marked = f"<{word}>"
    found = [zlib.crc32(marked[i : i + n].encode()) % LETTER_ROWS for n in GRAM_SIZES for i in range(len(marked) - n + 1)]
    return found or [zlib.crc32(marked.encode()) % LETTER_ROWS]


#: Of distinct tokens: the row of the whole word, the rows of all their n-grams in a row, and where each token's end (the first from 0).
Features = tuple[np.ndarray, np.ndarray, np.ndarray]


class Vocabulary:
    """Features of distinct tokens: the row of the whole word (0: unknown) and the rows of its letter n-grams."""

    def __init__(self, known: dict[str, int]) -> None:
        self.known = known

    def rows(self, distinct: list[str]) -> Features:
        words = [bare(t) for t in distinct]
        whole = np.array([self.known.get(w, 0) for w in words], dtype=np.int64)
        found = [np.array(grams(w), dtype=np.int32) for w in words]
        return whole, np.concatenate([np.empty(0, dtype=np.int32), *found]), np.r_[0, np.cumsum([len(g) for g in found], dtype=np.int64)]


def features_of(features: Features, rows: np.ndarray) -> Features:
    """The features of the tokens at ``rows``."""
    whole, letters, ends = features
    counts = (ends[1:] - ends[:-1])[rows]
    new = np.r_[0, np.cumsum(counts)]
    return whole[rows], letters[np.repeat(ends[rows] - new[:-1], counts) + np.arange(new[-1])], new


def inputs(p: dict[str, np.ndarray], whole: np.ndarray, letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What is known of each token whole, beside the mean over all its n-grams."""
    out = np.zeros((len(whole), WORD_DIM + LETTER_DIM), dtype=p["words"].dtype)
    out[:, :WORD_DIM] = p["words"][whole]
    at = 0
    while at < len(whole):  # a token is a piece at most, so a chunk always holds one
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_GRAMS, side="right")) - 1)
        sums = np.add.reduceat(p["letters"][letters[ends[at] : ends[to]]], ends[at:to] - ends[at], axis=0)
        out[at:to, WORD_DIM:] = sums / np.diff(ends[at : to + 1])[:, None]
        at = to
    return out


def initial(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    d = WORD_DIM + LETTER_DIM
    new = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    p = {"words": new(n_words + 1, WORD_DIM, scale=0.1), "letters": new(LETTER_ROWS, LETTER_DIM, scale=0.3)}
    p["words"][0] = 0
    for x in "fb":
        p |= {f"w{x}": new(d, 3 * HIDDEN, scale=0.35), f"u{x}": new(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{x}": np.zeros(3 * HIDDEN, dtype=np.float32)}
    return p | {"att": new(2 * HIDDEN, ATTENTION, scale=0.3), "att_v": new(ATTENTION, scale=0.3), "out": new(2 * HIDDEN, scale=0.3), "out_b": np.zeros(1, dtype=np.float32)}


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-7)


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of n words: every STRIDE words until the end is covered; one window for no words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def window_logits(p: dict[str, np.ndarray], projected: tuple[np.ndarray, np.ndarray], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, per: int = 2048) -> np.ndarray:
    """Scores of windows of the token rows ``ids``; a window ends at ``ends`` if that comes first."""
    out = np.empty(len(starts), dtype=np.float32)
    ids = np.r_[ids, np.zeros(WINDOW, dtype=ids.dtype)]
    for whole in (True, False):
        which = np.flatnonzero((ends - starts >= WINDOW) == whole)
        for lo in range(0, len(which), per):
            w = which[lo : lo + per]
            at = starts[w, None] + np.arange(WINDOW)
            mask = None if whole else (at < ends[w, None]).astype(np.float32)
            rows = ids[np.minimum(at, len(ids) - 1)]
            states = np.concatenate([gru(projected[i][rows], p[f"u{d}"], mask, d == "b") for i, d in enumerate("fb")], axis=2)
            out[w] = pooled_logits(states, mask, p)
    return out


def text_features(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest, second largest and mean window score of each text, whose windows start at ``first``."""
    n = np.diff(np.r_[first, len(logits)])
    top = np.maximum.reduceat(logits, first)
    hits = np.flatnonzero(logits == np.repeat(top, n))
    rest = logits.copy()
    rest[hits[np.searchsorted(hits, first)]] = -np.inf
    second = np.where(n > 1, np.maximum.reduceat(rest, first), top)
    return np.stack([top, second, np.add.reduceat(logits, first) / n], axis=1).astype(np.float64)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with intercept, by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = ridge * np.r_[np.ones(x.shape[1]), 0]
    for _ in range(steps):
        q = sigmoid(a @ w)
        g = a.T @ (weight * (q - y)) + penalty * w
        h = (a * (weight * q * (1 - q))[:, None]).T @ a + np.diag(penalty + 1e-6)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What scoring needs; picklable."""

    def __init__(self, p: dict[str, np.ndarray], known: dict[str, int], last: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> None:
        self.p, self.known, self.last, self.mean, self.scale = p, known, last, mean, scale

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(np.c_[(features - self.mean) / self.scale, np.ones(len(features))] @ self.last)


def fit(texts: list[str | None], labels: list[int], toxic_share: float, seed: int = 11) -> Model:
    """Fit on labelled texts; ``toxic_share`` is that of all labels, to which the last layer is weighted."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    words = [tokens(t) for t in texts]
    frequency: Counter[str] = Counter()
    for ws in words:
        frequency.update({bare(w) for w in ws})
    frequent = [w for w, n in sorted(frequency.items(), key=lambda x: (-x[1], x[0])) if n >= MIN_DOCUMENTS]
    known = {w: i + 1 for i, w in enumerate(frequent)}
    distinct: dict[str, int] = {}
    rows = [np.array([distinct.setdefault(w, len(distinct)) for w in ws], dtype=np.int64) for ws in words]
    features = Vocabulary(known).rows(list(distinct) or [""])
    p = initial(len(known), rng)

    doc, start, end, ids = [], [], [], np.concatenate([*rows, np.zeros(1, dtype=np.int64)])
    base = np.r_[0, np.cumsum([len(r) for r in rows])]
    for i, r in enumerate(rows):
        s = window_starts(len(r))
        doc += [i] * len(s)
        start += list(base[i] + s)
        end += [base[i + 1]] * len(s)
    doc_, start_, end_ = np.array(doc), np.array(start), np.array(end)
    held = np.arange(len(y)) % 4 == 3
    train = np.flatnonzero(~held[doc_])
    adam = Adam(p, RATE)

    def all_logits() -> np.ndarray:
        x = inputs(p, *features)
        return window_logits(p, tuple(x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"), ids, start_, end_)

    prior = np.r_[token_evidence(rows, features, len(known), np.where(held, -1, y)), 0.0]
    toxic = y[doc_] == 1
    for r in range(ROUNDS):
        if r:
            logits = all_logits()
        else:
            at = start_[:, None] + np.arange(WINDOW)
            logits = np.where(at < end_[:, None], prior[ids[np.minimum(at, len(ids) - 1)]], -np.inf).max(axis=1, initial=-99.0)
        rank = np.lexsort((-logits, doc_))
        place = np.empty(len(doc_), dtype=np.int64)
        first = np.r_[True, doc_[rank][1:] != doc_[rank][:-1]]
        place[rank] = np.arange(len(rank)) - np.maximum.accumulate(np.where(first, np.arange(len(rank)), 0))
        chosen = train[np.where(toxic[train], place[train] < 3, (place[train] < 3) | (rng.random(len(train)) < 0.3))]
        weight = np.where(y[doc_[chosen]] == 1, 0.5 / max(1, (y[doc_[chosen]] == 1).sum()), 0.5 / max(1, (y[doc_[chosen]] == 0).sum())) * len(chosen)
        order = rng.permutation(len(chosen))
        size = max(16, min(BATCH, len(order) // 60))
        for lo in range(0, len(order), size):
            b = order[lo : lo + size]
            w = chosen[b]
            at = start_[w, None] + np.arange(WINDOW)
            mask = (at < end_[w, None]).astype(np.float32)
            used, inverse = np.unique(ids[np.minimum(at, len(ids) - 1)], return_inverse=True)
            part = features_of(features, used)
            x = inputs(p, *part)
            _, grads, dx = loss_gradient(x, inverse.reshape(at.shape), mask, y[doc_[w]], weight[b].astype(np.float32), p)
            grads["words"] = np.zeros_like(p["words"])
            np.add.at(grads["words"], part[0], dx[:, :WORD_DIM])
            grads["words"][0] = 0
            grads["letters"] = np.zeros_like(p["letters"])
            counts = np.diff(part[2])
            np.add.at(grads["letters"], part[1], np.repeat(dx[:, WORD_DIM:] / counts[:, None].astype(dx.dtype), counts, axis=0))
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            adam.step({k: g / max(1.0, norm) for k, g in grads.items()})
    for k in ("words", "letters"):
        p[k] = np.ascontiguousarray(p[k])
    first = np.flatnonzero(np.r_[True, doc_[1:] != doc_[:-1]])
    x = text_features(all_logits(), first)
    use = held if len(set(y[held])) == 2 else np.ones(len(y), dtype=bool)
    mean, scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-6
    share = float(y[use].mean())
    weight = np.where(y[use] == 1, toxic_share / share, (1 - toxic_share) / (1 - share))
    return Model(p, known, logistic((x[use] - mean) / scale, y[use], weight), mean, scale)


def token_evidence(rows: list[np.ndarray], features: Features, n_words: int, y: np.ndarray) -> np.ndarray:
    """For each distinct token how much oftener it, or one of its letter n-grams, occurs in texts labelled 1 than in those labelled 0: the largest z of its features. Other labels are left out."""
    whole, letters, ends = features
    seen = np.zeros((2, n_words + 1 + LETTER_ROWS))
    for r, label in zip(rows, y, strict=True):
        if label in (0, 1):
            u = np.unique(r)
            seen[int(label), np.unique(whole[u])] += 1
            seen[int(label), n_words + 1 + np.unique(features_of(features, u)[1])] += 1
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    both = (seen[0] + seen[1] + 0.5) / (n0 + n1 + 1)
    z = (seen[1] / n1 - seen[0] / n0) / np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1))
    z[0] = -99
    return np.maximum(z[whole], np.maximum.reduceat(z[n_words + 1 + letters], ends[:-1]))


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    """Whether the id belongs to the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(id_.cast("string")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[list[str | None], list[int], float]:
    """At most ``sample`` texts of each label, by the hash of their ids, and the toxic share of all labels outside the held-out fold."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for label in (0, 1):
        some = usable.where(F.col("label") == label).orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # The picked ids are bounded by 2 * sample.
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label")).orderBy(F.md5(F.col("id").cast("string")), "id").collect()
    return [r["text"] for r in rows], [r["label"] for r in rows], share


def score_texts(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, score, n_windows and top_window (first word of the window that scores highest). A number as the model scores everything alike."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))  # pandas would round large ids beside nulls

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        cache: dict[str, int] = {}
        projected: tuple[np.ndarray, np.ndarray] = (np.empty((0, 3 * HIDDEN), dtype=np.float32),) * 2
        for batch in batches:
            if len(cache) > MAX_CACHED:
                cache, projected = {}, (projected[0][:0], projected[1][:0])
            rows, sizes, cut, before = [], [], [], len(cache)
            for text in batch["text"]:
                ws = tokens(text)
                sizes.append(len(ws))
                cut.append(max(map(len, ws), default=0) == PIECE)  # some word may have been cut
                for w in ws:
                    if w not in cache:
                        cache[w] = len(cache)
                rows.append(np.fromiter(map(cache.__getitem__, ws), dtype=np.int32, count=len(ws)))
            if isinstance(m, float):
                yield pd.DataFrame({"id": batch["id"], "score": m, "n_windows": [len(window_starts(n)) for n in sizes], "top_window": 0})
                continue
            new = list(cache)[before:] if before < len(cache) else []
            if new:
                parts = [inputs(m.p, *Vocabulary(m.known).rows(new[i : i + 20_000])) for i in range(0, len(new), 20_000)]
                projected = tuple(np.concatenate([projected[i], *(x @ m.p[f"w{d}"] + m.p[f"c{d}"] for x in parts)]) for i, d in enumerate("fb"))
            # The padded places of a window read a row, though it counts for nothing; that row is no part of the cache.
            table = projected if len(projected[0]) else (np.zeros((1, 3 * HIDDEN), dtype=np.float32),) * 2
            base = np.r_[0, np.cumsum(sizes)]
            local = [window_starts(n) for n in sizes]
            counts = np.array([len(s) for s in local])
            starts = np.concatenate([b + s for b, s in zip(base, local, strict=False)]) if local else np.empty(0, dtype=np.int64)
            if not len(starts):
                continue
            logits = window_logits(m.p, table, np.concatenate(rows), starts, np.repeat(base[1:], counts))
            first = np.cumsum(counts) - counts
            top = [int(local[i][int(np.argmax(logits[f : f + n]))]) for i, (f, n) in enumerate(zip(first, counts, strict=True))]
            top = [word_of_token(text, t) if long else t for text, t, long in zip(batch["text"], top, cut, strict=True)]
            yield pd.DataFrame({"id": batch["id"], "score": m.scores(text_features(logits, first)), "n_windows": counts, "top_window": top})

    out = thin.mapInPandas(scored, "id string, score double, n_windows long, top_window long")
    return out.select(F.col("id").cast(id_type).alias(id_col), "score", "n_windows", "top_window")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Fit on the labels outside the held-out fold, score every document: id, held_out, score, predicted, n_windows, top_window."""
    texts, y, share = labelled_sample(docs, labels, id_col, text_col, label_col)
    model: Model | float = fit(texts, y, share) if len(set(y)) == 2 else float(share)
    return score_texts(docs, model, id_col, text_col).select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "top_window"
    )
