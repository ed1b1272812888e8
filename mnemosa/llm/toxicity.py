"""Toxicity by a bidirectional gated recurrent network over overlapping windows of words and characters.

Texts are tokens: runs of letters, of digits or of other signs, so that every byte
but white space is read.  A token enters the network twice.  By word: a learned
vector of each word that enough training texts hold, and one for all others.  By
characters: filters over FIELD adjacent bytes with learned weights, of each of
which the largest value in the token counts, so unseen and masked forms look like
what they resemble.  A forward and a backward gated recurrent layer read each
window of WINDOW tokens, attention pools their states, and a linear layer gives
the window's logit.  Windows begin every STRIDE tokens, so each token stands in
two, and all are scored.  A text's score is that of its highest window,
calibrated on labelled texts that the network didn't learn from.

All weights, those of words and bytes too, are trained in numpy by
back-propagation through time, on at most `most` labelled texts, less a fifth for
calibration.  Positive texts give their most suspicious window, chosen anew at
every third pass by the network's own scores (at first by the words' log-odds,
which only this first choice uses); negative texts give theirs and some others.
While it learns, words are now and then read as unknown, so that it can't do
without the characters.

Scoring is one pass without a shuffle; the model is a vector for each word of the
training texts and some twenty thousand weights.

Defined cases: null text counts as empty; texts without a token score as the mean
text of label 0 does; labels that are null, or without a text, are not learnt from; with fewer
than sixteen texts of either label every score is the share of label 1 (0 without
labels).  Repeated rows get a result each, equal texts of the labels count once, and of
several texts of one doc_id the first in their order is learnt from;
a null doc_id is held out of nothing; an empty table gives no rows.  Other columns
of documents are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Tokens, held_out, pieces

WINDOW, STRIDE, HIDDEN, POOL = 32, 16, 8, 8
#: Sizes of a word's vector, of the number of byte filters, of what a filter sees.
WORD, FILTERS, FIELD = 8, 16, 5
INPUTS = WORD + FILTERS
MOST_ROWS, LEAST_TEXTS, LEAST_OF_A_LABEL, LEAST_STEPS = 4000, 5, 16, 400
#: Share of words read as unknown while learning, and pull of words' vectors to 0.
UNKNOWN, DECAY = 0.3, 1e-4
THRESHOLD = 0.3
SPACE = 32
#: Networks that are trained, of which one is kept.
TRIES = 4
#: Bytes of text that are scored at a time.
AT_ONCE = 1 << 18
#: Rows of every matrix product in scoring; of another shape, the last bits of a row's result can differ.
TOGETHER = 512


class Vocabulary:
    """Distinct tokens of a run of rows, with their bytes."""

    def __init__(self, column: pa.Array):
        tokens = Tokens(column, lower=True)
        self.bounds = tokens.bounds
        self.words, first, self.ids = np.unique(tokens.hashes(), return_index=True, return_inverse=True)
        self.size = (tokens.ends - tokens.starts)[first]
        self.data = tokens.data[np.repeat(tokens.starts[first] - (np.cumsum(self.size) - self.size), self.size) + np.arange(self.size.sum())]


class Letters:
    """Bytes of some tokens, each with a space before and FIELD - 1 behind, and the places where a filter can begin."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        span = size + FIELD
        start = np.cumsum(span) - span
        self.bytes = np.full(int(span.sum()), SPACE, np.uint8)
        self.bytes[np.repeat(start + 1 - (np.cumsum(size) - size), size) + np.arange(len(data))] = data
        self.first = np.cumsum(size + 1) - (size + 1)
        self.at = np.repeat(start - self.first, size + 1) + np.arange(int((size + 1).sum()))
        self.of = np.repeat(np.arange(len(size)), size + 1)


def _padded(x: np.ndarray) -> np.ndarray:
    """x with rows of zeros up to a multiple of TOGETHER, at least one."""
    more = -len(x) % TOGETHER if len(x) else TOGETHER
    return np.concatenate([x, np.zeros((more, *x.shape[1:]), x.dtype)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Encoder:
    """Inputs of tokens: a vector by word, and the largest value of each byte filter."""

    def __init__(self, words: np.ndarray, seed: int = 7):
        """words: the sorted hashes of known words."""
        rng = np.random.default_rng(seed)
        self.words = words
        self.vectors = (0.1 * rng.standard_normal((len(words) + 1, WORD))).astype(np.float32)  # row 0 is any other word's
        self.filters = (0.3 * rng.standard_normal((FIELD, 256, FILTERS))).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word's vector, 0 for unknown ones."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at + 1, 0)

    def _responses(self, letters: Letters) -> np.ndarray:
        out = self.filters[0][letters.bytes[letters.at]]
        for k in range(1, FIELD):
            out += self.filters[k][letters.bytes[letters.at + k]]
        return out

    def by_bytes(self, letters: Letters) -> np.ndarray:
        return np.tanh(np.maximum.reduceat(self._responses(letters), letters.first) + self.bias) if len(letters.first) else np.zeros((0, FILTERS), np.float32)

    def __call__(self, numbers: np.ndarray, letters: Letters) -> np.ndarray:
        return np.concatenate([self.vectors[numbers], self.by_bytes(letters)], 1)

    def gradients(self, numbers: np.ndarray, letters: Letters, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """From those of the inputs: rows of vectors and their gradients, and those of filters and bias."""
        rows, at = np.unique(numbers, return_inverse=True)
        g = np.zeros((len(rows), WORD), dx.dtype)
        np.add.at(g, at, dx[:, :WORD])
        response = self._responses(letters)
        most = np.maximum.reduceat(response, letters.first)
        dm = dx[:, WORD:] * (1 - np.tanh(most + self.bias) ** 2)
        place, f = np.nonzero(response == most[letters.of])
        _, once = np.unique(letters.of[place] * FILTERS + f, return_index=True)
        place, f = place[once], f[once]
        back = dm[letters.of[place], f]
        filters = np.stack([np.bincount(letters.bytes[letters.at[place] + k].astype(np.int64) * FILTERS + f, back, 256 * FILTERS).reshape(256, FILTERS) for k in range(FIELD)])
        return rows, g, {"filters": filters.astype(dx.dtype), "bias": dm.sum(0)}


class Network:
    """Two gated recurrent layers, attention and a linear layer; all parameters in `p`."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        h = HIDDEN
        self.p = {f"{k}{d}": x for d in "fb" for k, x in (("W", draw(INPUTS, 3 * h)), ("U", draw(h, 3 * h)), ("B", np.zeros(3 * h, np.float32)))}
        self.p |= {"A": draw(2 * h, POOL), "a": np.zeros(POOL, np.float32), "v": draw(POOL), "w": draw(2 * h), "c": np.zeros(1, np.float32)}

    def layer(self, d: str, projected, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, rows, HIDDEN); projected(t) gives the step's inputs times W plus B."""
        u, h, steps = self.p[f"U{d}"], HIDDEN, mask.shape[1]
        state = np.zeros((mask.shape[0], h), np.float32)
        out = np.zeros((steps, mask.shape[0], h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, y = projected(t), state @ u
            zr = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
            new = n + z * (state - n)
            m = mask[:, t : t + 1]
            after = state + m * (new - state)
            if keep is not None:
                keep.append((t, state, z, r, n, y[:, 2 * h :], m))
            state = out[t] = after
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple:
        p = self.p
        u = np.tanh(states @ p["A"] + p["a"])
        s = np.where(mask.T > 0, u @ p["v"], np.float32(-1e9))
        e = np.exp(s - s.max(0))
        alpha = e / e.sum(0)
        c = (alpha[:, :, None] * states).sum(0)
        return u, alpha, c, c @ p["w"] + p["c"][0]

    def logits(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows of words: x has the inputs of each distinct word; a window's value doesn't depend on the others."""
        x = _padded(x)
        f, b = (np.concatenate([x[i : i + TOGETHER] @ self.p[f"W{d}"] for i in range(0, len(x), TOGETHER)]) + self.p[f"B{d}"] for d in "fb")
        out, n = [], len(ids)
        ids, mask = _padded(ids), _padded(mask.astype(np.float32))
        mask[n:, 0] = 1
        for i in range(0, len(ids), TOGETHER):
            at, m = ids[i : i + TOGETHER].T, mask[i : i + TOGETHER]
            states = np.concatenate([self.layer("f", lambda t: f[at[t]], m), self.layer("b", lambda t: b[at[t]], m)], 2)  # noqa: B023
            out.append(self.pooled(states, m)[3])
        return np.concatenate(out)[:n]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean weighted log-loss, by parameter and by input; x is (rows, steps, INPUTS)."""
        p, h, into = self.p, HIDDEN, np.zeros_like(x)
        kept: dict[str, list] = {"f": [], "b": []}
        sides = []
        for d in "fb":
            px = x @ p[f"W{d}"] + p[f"B{d}"]
            sides.append(self.layer(d, lambda t: px[:, t], mask, kept[d]))  # noqa: B023
        states = np.concatenate(sides, 2)
        u, alpha, c, logit = self.pooled(states, mask)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = (_sigmoid(logit) - y) * weight / weight.sum()
        g["c"][0], g["w"] = dl.sum(), c.T @ dl
        dc = dl[:, None] * p["w"]
        dstates = alpha[:, :, None] * dc
        da = (states * dc).sum(2)
        ds = alpha * (da - (alpha * da).sum(0))
        g["v"] = (u * ds[:, :, None]).sum((0, 1))
        du = ds[:, :, None] * p["v"] * (1 - u * u)
        g["a"] = du.sum((0, 1))
        g["A"] = np.einsum("trh,trk->hk", states, du)
        dstates = dstates + du @ p["A"].T
        for k, d in enumerate("fb"):
            out, carry = dstates[:, :, k * h : (k + 1) * h], np.zeros((len(x), h), np.float32)
            for t, before, z, r, n, yn, m in reversed(kept[d]):
                total = carry + out[t]
                new = total * m
                dn = new * (1 - z) * (1 - n * n)
                dz = new * (before - n) * z * (1 - z)
                dr = dn * yn * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], 1)
                dy = np.concatenate([dz, dr, dn * r], 1)
                g[f"W{d}"] += x[:, t].T @ dx
                into[:, t] += dx @ p[f"W{d}"].T
                g[f"B{d}"] += dx.sum(0)
                g[f"U{d}"] += before.T @ dy
                carry = total * (1 - m) + new * z + dy @ p[f"U{d}"].T
        return g, into


def cut(bounds: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows: row, word ids (0 where there is no word), whether there is one; the last one of a row reaches its end."""
    count = np.diff(bounds)
    many = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(count)), many)
    first = ((np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE).astype(np.int32)
    at = first[:, None] + np.arange(WINDOW, dtype=np.int32)
    mask = at < count[row].astype(np.int32)[:, None]
    at += bounds[:-1][row].astype(np.int32)[:, None]
    at[~mask] = 0
    return row, ids[at] if len(ids) else np.zeros(at.shape, np.int32), mask


class Detector:
    """A trained scorer of texts."""

    def __init__(self, share: float, encoder: Encoder | None = None, network: Network | None = None, scale: tuple[float, float] = (1.0, 0.0), empty: float = 0.0):
        self.share, self.encoder, self.network, self.scale, self.empty = share, encoder, network, scale, empty

    def raw(self, texts: pa.Array) -> np.ndarray:
        v = Vocabulary(texts)
        x = self.encoder(self.encoder.number(v.words), Letters(v.data, v.size))
        row, ids, mask = cut(v.bounds, v.ids)
        out = np.full(len(v.bounds) - 1, -np.inf)
        np.maximum.at(out, row, self.network.logits(x if len(x) else np.zeros((1, INPUTS), np.float32), ids, mask))
        out[np.diff(v.bounds) == 0] = self.empty
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not self.network:
            return np.full(len(texts), self.share)
        return np.round(1 / (1 + np.exp(-np.clip(self.scale[0] * self.raw(texts) + self.scale[1], -30, 30))), 6)


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through labelled raw scores: Newton steps, halved while they don't help.

    Targets are pulled from 0 and 1 as if each label had one more text of either
    kind, so that labels which the scores part wholly give a curve too.
    """
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x = np.stack([raw, np.ones_like(raw)], 1)
    loss = lambda t: float(np.logaddexp(0, x @ t).sum() - target @ (x @ t))
    t = np.array([0.0, np.log((ones + 1) / (len(y) - ones + 1))])
    for _ in range(50):
        q = _sigmoid(x @ t)
        move = np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - q))
        step = 1.0
        while step > 1e-6 and loss(t + step * move) > loss(t):
            step /= 2
        t = t + step * move
        if np.abs(step * move).max() < 1e-9:
            break
    return max(0.05, float(t[0])), float(t[1])


class Adam:
    """Steps with running means of gradients and of their squares; of tables, only rows that have a gradient move."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.rate, self.step = rate, 0
        self.mean = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}

    def __call__(self, params: dict[str, np.ndarray], g: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        for k, q in g.items():
            at, (m, s) = rows.get(k, slice(None)), self.mean[k]
            q = q * min(1.0, 5.0 / (norm + 1e-9))
            m[at] += 0.1 * (q - m[at])
            s[at] += 0.01 * (q * q - s[at])
            params[k][at] -= (self.rate * (m[at] / (1 - 0.9**self.step)) / (np.sqrt(s[at] / (1 - 0.99**self.step)) + 1e-6)).astype(np.float32)


class Lesson:
    """Windows of labelled texts as numbers of distinct words; texts are read in runs of half a megabyte."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        found = [Vocabulary(batch.column(0)) for batch in pieces(pa.record_batch([pa.array(texts, pa.string())], ["text"]))] or [Vocabulary(pa.array([], pa.string()))]
        self.words, first, which = np.unique(np.concatenate([v.words for v in found]), return_index=True, return_inverse=True)
        size = np.concatenate([v.size for v in found])
        begin, self.size = np.cumsum(size) - size, size[first]
        data, self.begin = np.concatenate([v.data for v in found]), np.cumsum(self.size) - self.size
        self.data = data[np.repeat(begin[first] - self.begin, self.size) + np.arange(self.size.sum())]
        at = np.cumsum([0, *(len(v.words) for v in found)])
        ids = np.concatenate([which[a : a + len(v.words)][v.ids] for a, v in zip(at, found, strict=False)]).astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(v.bounds) for v in found]))]).astype(np.int64)
        self.row, self.ids, self.mask = cut(bounds, ids)
        self.y = labels
        pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(bounds)) * max(1, len(self.words)) + ids)
        word, of = pairs % max(1, len(self.words)), pairs // max(1, len(self.words))
        positive, negative = (np.bincount(word, x[of], len(self.words)) for x in (labels, 1 - labels))
        self.texts = positive + negative
        self.odds = np.log((positive + 0.3) / (labels.sum() + 0.6)) - np.log((negative + 0.3) / ((1 - labels).sum() + 0.6))

    def letters(self, words: np.ndarray) -> Letters:
        size = self.size[words]
        return Letters(self.data[np.repeat(self.begin[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size)

    def suspicion(self) -> np.ndarray:
        """Of each window the largest log-odds of its words that several texts hold."""
        of = np.where(self.texts >= LEAST_TEXTS, self.odds * np.sqrt(self.texts), 0.0)
        return np.where(self.mask, of[self.ids], -np.inf).max(1) if len(of) else np.zeros(len(self.row))

    def logits(self, encoder: Encoder, network: Network) -> np.ndarray:
        number, step = encoder.number(self.words), 1 << 13
        parts = [encoder(number[i : i + step], self.letters(np.arange(i, min(i + step, len(number))))) for i in range(0, len(number), step)]
        x = np.concatenate(parts) if parts else np.zeros((1, INPUTS), np.float32)
        return network.logits(x, self.ids, self.mask)

    def of_texts(self, logits: np.ndarray) -> np.ndarray:
        out = np.full(len(self.y), -np.inf)
        np.maximum.at(out, self.row, logits)
        return out


def learn(lesson: Lesson, seed: int = 7, passes: int = 12) -> tuple[Encoder, Network]:
    rng = np.random.default_rng(seed)
    encoder, network = Encoder(lesson.words[lesson.texts >= LEAST_TEXTS], seed), Network(seed)
    number = encoder.number(lesson.words)
    params = network.p | {"vectors": encoder.vectors, "filters": encoder.filters, "bias": encoder.bias}
    adam, row, y = Adam(params, 0.01), lesson.row, lesson.y
    suspect = lesson.suspicion()
    passes = int(np.clip(LEAST_STEPS * 128 // (2 * len(y)), passes, 60))
    for turn in range(passes):
        if turn and turn % 3 == 0:
            suspect = lesson.logits(encoder, network)
        order = np.lexsort((-suspect, row))
        top = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        extra = rng.permutation(len(row))[: len(top)]
        chosen = np.concatenate([top, extra[y[row[extra]] == 0]])
        rng.shuffle(chosen)
        target = y[row[chosen]]
        heavy = np.where(target == 1, max(1.0, (target == 0).sum() / max(1, (target == 1).sum()) / 2), 1.0)
        adam.rate = 0.01 if turn < passes * 2 // 3 else 0.003
        for i in range(0, len(chosen), 128):
            c = chosen[i : i + 128]
            words, at = np.unique(lesson.ids[c], return_inverse=True)
            if not len(lesson.words):
                continue
            at = at.reshape(len(c), WINDOW)
            known = np.where(rng.random(len(words)) < UNKNOWN, 0, number[words])
            letters, mask = lesson.letters(words), lesson.mask[c].astype(np.float32)
            x = encoder(known, letters)
            g, into = network.gradients(x[at] * mask[:, :, None], mask, target[i : i + 128], heavy[i : i + 128])
            dx = np.zeros_like(x)
            np.add.at(dx, at.ravel(), (into * mask[:, :, None]).reshape(-1, INPUTS))
            rows, gv, more = encoder.gradients(known, letters, dx)
            adam(params, g | more | {"vectors": gv + DECAY * encoder.vectors[rows]}, {"vectors": rows})
    return encoder, network


def train(texts: list[str], labels: np.ndarray, seed: int = 7, tries: int = TRIES) -> Detector:
    """From labelled texts; equal texts count once.  Of `tries` networks the one with the least calibrated loss on the texts set aside."""
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    keep = sorted(first.values())
    texts, labels = [texts[i] for i in keep], np.asarray(labels, float)[keep]
    share = float(labels.mean()) if len(labels) else 0.0
    if min(labels.sum(), (1 - labels).sum()) < LEAST_OF_A_LABEL:
        return Detector(share)
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(labels), bool)
    for side in (0, 1):
        at = rng.permutation(np.flatnonzero(labels == side))
        aside[at[: len(at) // 5]] = True
    part = lambda which: Lesson([t for t, w in zip(texts, which, strict=True) if w], labels[which])
    lesson, check, best = part(~aside), part(aside), None
    for k in range(tries):
        encoder, network = learn(lesson, seed + k)
        raw = check.of_texts(check.logits(encoder, network))
        scale = _platt(raw, check.y)
        loss = float(np.logaddexp(0, np.where(check.y == 1, -1, 1) * (scale[0] * raw + scale[1])).sum())
        if best is None or loss < best[0]:
            best = loss, Detector(share, encoder, network, scale, float(raw[check.y == 0].mean()))
    return best[1]


def examples(docs: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], most: int) -> DataFrame:
    """doc_id, y, text of at most `most` labels, picked by a hash of doc_id, none of them held out: a text a label, however many rows have its id."""
    picked = labels.where(F.col(label).isNotNull() & ~held_out(*held)).select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")
    return met.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held: tuple[int, int] = (4, 2), most: int = MOST_ROWS) -> Detector:
    """Train on at most `most` labelled texts, picked by a hash of doc_id, none of them held out.

    One task trains, with those texts alone; the driver gets the model.
    """
    rows = examples(docs, labels, label, held, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            known = pa.Table.from_batches(found).sort_by([("doc_id", "ascending"), ("text", "ascending"), ("y", "ascending")])
            model = train(known.column("text").to_pylist(), known.column("y").to_numpy())
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()  # one row, if there is any text
    return pickle.loads(made[0]["model"]) if made else train([], np.zeros(0))


def score(docs: DataFrame, model, held: tuple[int, int] = (4, 2), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; model gives the scores of an array of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most=AT_ONCE):
                value = shared.value(batch.column("text"))
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(value.astype(float)), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(*held).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most=AT_ONCE):
                yield batch.filter(pa.array(shared.value(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
