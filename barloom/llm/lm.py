"""Text scores from a causal self-attention model over subword ids, trained in numpy.

Tokens are a text's words, A-Z lower-cased, and one end. Their counts over all training texts give the base score. The
model factors a token's probability into that of its class, which attention predicts from the subword ids of the tokens
before it, and that of the token within its class, which the counts give; classes group tokens by first subword id, ids
that keep company in the same texts together, with one for the end. An unseen token keeps its counted probability. So the
model's score is the base score plus, over the tokens, the log ratio of predicted and counted class probability.

How it runs: texts lie in blocks of consecutive rows. A block numbers its distinct words, sends them with their training
counts to the ranges of a hash, and keeps its texts as numbers; a range adds up the counts of its words over all blocks and
cuts them into subword ids, and sends each block the counts and ids of its words back. So words travel once per block and
range, compressed, texts travel as numbers only, and no table of all words is held anywhere. Blocks are then written in lots
of whole texts, with the counts and ids of their words, and read three ways.
Classes: each text adds the sum of its ids' random directions to the profile of each of its ids, and profiles summed over
all training texts are grouped. Weights: every task goes over the training texts of its lots from the same weights, the
weights are averaged, each id's by its occurrences, and this is done ``epochs`` times. Scores: windows of tokens overlap,
every window attends within itself under a causal mask, many windows at once, and its first part is context for the rest,
so each token is scored once. Counts, classes and weights come from all training texts; ``sample`` bounds the texts that
classes and weights learn from, by hash of their id, for trials.

Rules: a null text is empty and holds the end alone; repeated rows are scored and counted each; only doc_id and text are
read; without training texts every token is unseen; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm import bpe
from barloom.llm.common import documents, forget, stored, tasks

#: Tokens in a window, context tokens in it, width of the model, classes of words.
WINDOW, CONTEXT, WIDTH, CLASSES = 64, 16, 16, 64

#: Rows of a window that are attended together. The first are context only, except where a text begins.
STRIPS = ((0, CONTEXT), (CONTEXT, WINDOW))

#: Directions of a profile, tokens of a lot of texts and of a block, about, ids in a piece of the weights.
PROFILE, LOT, BLOCK, PIECE = 32, 1 << 19, 1 << 21, 4096


def words(text: str | None) -> list[bytes]:
    """bytes.lower changes A-Z only, and bytes.split parts at ASCII white space only."""
    return (text or "").encode().lower().split()


def subwords(tokens: list[bytes], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """All subword ids of the words, end to end, and how many each has."""
    encoder = bpe._encoder(path, pattern)
    starts = _starts(path, pattern)
    every, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for s in range(0, len(tokens), 4096):
        part = tokens[s : s + 4096]
        ids = encoder.encode_to_numpy(" " + " ".join(t.decode("utf-8", "replace") for t in part), disallowed_special=())
        at = np.flatnonzero(starts[ids])
        if len(at) != len(part):
            at, ids = _one_by_one(part, encoder)
        every.append(ids.astype(np.int32))
        sizes.append(np.diff(np.append(at, len(ids))).astype(np.int32))
    return np.concatenate(every), np.concatenate(sizes)


def _one_by_one(tokens: list[bytes], encoder) -> tuple[np.ndarray, np.ndarray]:
    parts = [encoder.encode_to_numpy(" " + t.decode("utf-8", "replace"), disallowed_special=()) for t in tokens]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(int), np.concatenate(parts)


_START_MEMO: dict[str, np.ndarray] = {}


def _starts(path: str, pattern: str) -> np.ndarray:
    """Which ids begin with a space."""
    if path not in _START_MEMO:
        encoder = bpe._encoder(path, pattern)
        _START_MEMO[path] = np.array([encoder.decode_single_token_bytes(i).startswith(b" ") for i in range(encoder.n_vocab)])
    return _START_MEMO[path]


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of these stretches, end to end."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def summed(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with the same number, a row for each number below ``n``."""
    return np.stack([np.bincount(of, c, n) for c in np.ascontiguousarray(values.T)], 1).astype(values.dtype)


def compact(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` numbers occur, ascending, and the place of each among them."""
    there = np.zeros(n, bool)
    there[at.ravel()] = True
    rows = np.flatnonzero(there)
    place = np.empty(n, np.int32)
    place[rows] = np.arange(len(rows))
    return rows, place[at]


class Words:
    """Tokens that subword ids make up: their ids end to end, and how many each has."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes, self.begins = ids, sizes, np.cumsum(sizes) - sizes

    def pick(self, at: np.ndarray) -> Words:
        return Words(self.ids[spans(self.begins[at], self.sizes[at])], self.sizes[at])


class Attention:
    """One causal attention layer over the mean embeddings of a token's ids, with a bias per distance, and a class output."""

    def __init__(self, ids: int, classes: int, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": (r.standard_normal((ids + 1, WIDTH)) * 0.3).astype(np.float32), "q": f(WIDTH, WIDTH), "k": f(WIDTH, WIDTH), "v": f(WIDTH, WIDTH), "o": 0.1 * f(WIDTH, classes), "r": 0.1 * f(WIDTH, classes), "b": np.zeros(classes, np.float32), "d": np.zeros(WINDOW, np.float32)}
        self.start()

    @classmethod
    def of(cls, weights: dict[str, np.ndarray]) -> Attention:
        model = object.__new__(cls)
        model.p = {n: x.copy() for n, x in weights.items()}
        model.start()
        return model

    def start(self) -> None:
        """Nothing learnt yet from these weights on."""
        self.m = {n: (np.zeros_like(x), np.zeros_like(x)) for n, x in self.p.items()}
        self.steps = 0

    def vectors(self, words: Words) -> np.ndarray:
        """Twice the mean embedding of each word's ids."""
        return np.add.reduceat(self.p["e"][words.ids], words.begins, axis=0) * (2 / words.sizes).astype(self.p["e"].dtype)[:, None]

    @staticmethod
    def _distance() -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(WINDOW)
        gap = i[:, None] - i[None, :]
        return np.maximum(gap, 0), gap < 0

    def _mixing(self) -> np.ndarray:
        """One matrix for q, k, v and a column of ones."""
        p = self.p
        w = np.zeros((WIDTH + 1, 3 * WIDTH + 1), p["q"].dtype)
        w[:WIDTH, : 3 * WIDTH] = np.concatenate([p["q"] / np.sqrt(WIDTH).astype(w.dtype), p["k"], p["v"]], 1)
        w[WIDTH, 3 * WIDTH] = 1
        return w

    def outputs(self, x: np.ndarray, on: np.ndarray):
        """Vectors (windows x WINDOW x WIDTH) of the tokens before -> class values before normalising at the places ``on``, and
        what the backward pass needs. Rows of a strip attend to the keys up to its end, in the windows that ask for any of them."""
        p = self.p
        gap, future = self._distance()
        bias = np.where(future, np.float32(-1e9), p["d"][gap])
        one = np.ones((*x.shape[:2], 1), x.dtype)
        mixed = (np.concatenate([x, one], 2).reshape(-1, WIDTH + 1) @ self._mixing()).reshape(*x.shape[:2], -1)
        q, k, v = mixed[..., :WIDTH], mixed[..., WIDTH : 2 * WIDTH], mixed[..., 2 * WIDTH :]
        h = np.ones_like(v)
        strips = []
        for low, high in STRIPS:
            asked = on[:, low:high].any(1)
            who = slice(None) if asked.all() else np.flatnonzero(asked)
            s = q[who, low:high] @ k[who, :high].transpose(0, 2, 1)
            s += bias[low:high, :high]
            own = s[:, np.arange(high - low), np.arange(low, high)]
            if s.max(initial=0) > 60 or own.min(initial=0) < -60:  # elsewhere exp neither overflows nor vanishes
                s -= s.max(-1, keepdims=True)
            np.exp(s, out=s)
            h[who, low:high] = s @ v[who, :high]  # its last column holds the sums
            strips.append((low, high, who, s))
        z = h[..., WIDTH:]
        h = h[..., :WIDTH] / z
        seen = np.concatenate([h, x, one], 2)[on]
        y = seen @ np.concatenate([p["o"], p["r"], p["b"][None]])
        if y.max(initial=0) > 60 or y.min(initial=0) < -60:
            y -= y.max(-1, keepdims=True)
        return y, (x, q, k, v, strips, h, z, seen)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[Words, np.ndarray]:
        n = len(self.p["e"])
        rows, at = np.unique(a * n + b, return_inverse=True)
        return Words(np.stack([rows // n, rows % n], 1).ravel(), np.full(len(rows), 2)), at.reshape(a.shape)

    def forward(self, a: np.ndarray, b: np.ndarray):
        """Tokens of two ids each (windows x WINDOW), those before -> log probabilities of classes, and what the backward pass needs."""
        words, at = self._pairs(a, b)
        y, rest = self.outputs(self.vectors(words)[at], np.ones(a.shape, bool))
        y -= np.log(np.exp(y).sum(-1, keepdims=True))
        return y.reshape(*a.shape, -1), rest

    def gains(self, x: np.ndarray, target: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Log probability of the target class at each place ``on``."""
        y, _ = self.outputs(x, on)
        own = y[np.arange(len(y)), target[on]]
        np.exp(y, out=y)
        return own - np.log(y @ np.ones(y.shape[1], y.dtype))

    def step(self, a: np.ndarray, b: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> float:
        return self.learn(*self._pairs(a, b), target, weight, rate)

    def learn(self, words: Words, at: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One step on windows of tokens, ``at`` in ``words``: the mean loss before it."""
        p = self.p
        rows, back = compact(at, len(words.sizes))
        words, on = words.pick(rows), weight > 0
        g, (x, q, k, v, strips, h, z, seen) = self.outputs(self.vectors(words)[back], on)
        n = max(1.0, float(weight.sum()))
        of, share = (np.arange(len(g)), target[on]), (weight[on] / n).astype(g.dtype)
        np.exp(g, out=g)
        total = g @ np.ones(g.shape[1], g.dtype)
        loss = -float((np.log(g[of] / total) * share).sum())
        g *= (share / total)[:, None]
        g[of] -= share
        out = seen.T @ g
        d = {"o": out[:WIDTH], "r": out[WIDTH : 2 * WIDTH], "b": out[2 * WIDTH]}
        dseen = np.zeros((*x.shape[:2], 2 * WIDTH), g.dtype)
        dseen[on] = g @ np.concatenate([p["o"], p["r"]]).T
        dh, dx = dseen[..., :WIDTH] / z, dseen[..., WIDTH:]
        da = np.concatenate([dh, -(dh * h).sum(-1, keepdims=True)], 2)
        dmixed, by_distance = np.zeros((*x.shape[:2], 3 * WIDTH), g.dtype), np.zeros(WINDOW)
        gap, future = self._distance()
        for low, high, who, s in strips:
            ds = da[who, low:high] @ v[who, :high].transpose(0, 2, 1)
            ds *= s
            dmixed[who, low:high, :WIDTH] = ds @ k[who, :high]
            dmixed[who, :high, WIDTH : 2 * WIDTH] += ds.transpose(0, 2, 1) @ q[who, low:high]
            dmixed[who, :high, 2 * WIDTH :] += s.transpose(0, 2, 1) @ dh[who, low:high]
            past = ~future[low:high, :high]
            by_distance += np.bincount(gap[low:high, :high][past], (np.ones(len(ds), g.dtype) @ ds.reshape(len(ds), past.size)).reshape(past.shape)[past], WINDOW)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        dx = flat(dx) + flat(dmixed) @ self._mixing()[:WIDTH, : 3 * WIDTH].T
        mixing = flat(x).T @ flat(dmixed)
        d |= {"q": mixing[:, :WIDTH] / np.sqrt(WIDTH).astype(g.dtype), "k": mixing[:, WIDTH : 2 * WIDTH], "v": mixing[:, 2 * WIDTH :], "d": by_distance.astype(g.dtype)}
        of_word = summed(dx, back.ravel(), len(rows)) * (2 / words.sizes).astype(g.dtype)[:, None]
        ids, of_id = compact(words.ids, len(p["e"]))
        d["e"] = summed(np.repeat(of_word, words.sizes, axis=0), of_id, len(ids))
        self.steps += 1
        fix = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for name, grad in d.items():
            to = ids if name == "e" else slice(None)
            m1, m2 = self.m[name]
            mean, square = 0.9 * m1[to] + 0.1 * grad, 0.999 * m2[to] + 0.001 * grad * grad
            m1[to], m2[to] = mean, square
            p[name][to] -= rate * fix * mean / (np.sqrt(square) + 1e-8)
        return loss


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of these many tokens, end to end -> per window the places of its tokens, whether there is one, and whether it is scored here."""
    stride = WINDOW - CONTEXT
    count = np.maximum(1, -(-(lengths - CONTEXT) // stride))
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(lengths) - lengths)[text]
    inner = number[:, None] * stride + np.arange(WINDOW)[None, :]
    there = inner < lengths[text][:, None]
    scored = there & ((np.arange(WINDOW)[None, :] >= CONTEXT) | (number[:, None] == 0))
    return np.where(there, start[:, None] + inner, 0), there, scored


def class_prior(of: np.ndarray, n_of: np.ndarray, kinds_of: np.ndarray, ends: int, mass: float) -> np.ndarray:
    """Log10 of the counted probability of each class: what the base gives its tokens together. The last class is the end."""
    out = np.bincount(of[: len(n_of)], n_of + 0.5 * kinds_of, CLASSES + 1)
    out[CLASSES] = ends + 0.5
    return np.log10(np.maximum(out, 0.5) / mass)


def directions(n: int, seed: int = 5) -> np.ndarray:
    """A random direction of ``PROFILE`` signs for each id."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (n, PROFILE))


def add_profiles(into: np.ndarray, firsts: np.ndarray, text_of: np.ndarray, signs: np.ndarray, common: np.ndarray) -> None:
    """Adds to each id's profile the directions of the other ids of each of its texts, common ids counting less."""
    pairs = np.unique(text_of.astype(np.int64) * len(into) + firsts)
    texts, ids = pairs // len(into), pairs % len(into)
    own = signs[ids] * common[ids][:, None]
    begins = np.flatnonzero(np.diff(texts, prepend=-1))
    whole = np.add.reduceat(own, begins, axis=0)
    rows, of = np.unique(ids, return_inverse=True)
    into[rows] += summed(np.repeat(whole, np.diff(np.append(begins, len(ids))), axis=0) - own, of, len(rows))


def word_classes(profiles: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Class of each first id: k-means over the profiles' directions; ids without a profile by their number."""
    out = (np.arange(len(profiles)) % n).astype(np.int64)
    size = np.linalg.norm(profiles, axis=1)
    ids = np.flatnonzero(size > 0)
    if len(ids) <= n:
        out[ids] = np.arange(len(ids)) % n
        return out
    x = profiles[ids] / size[ids][:, None]
    centre = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(12):
        near = np.argmax(x @ centre.T, axis=1)
        for c in range(n):
            if (near == c).any():
                centre[c] = x[near == c].mean(0)
                centre[c] /= max(1e-12, np.linalg.norm(centre[c]))
    out[ids] = near
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(struct.pack("<I", a.nbytes) + a.tobytes() for a in arrays), 3)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        (n,) = struct.unpack_from("<I", raw, at)
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 4))
        at += 4 + n
    return out


class Lot:
    """Whole texts as numbers: their ids and marks, their tokens, and the counts and subword ids of the words."""

    KINDS = ("<i8", "?", "?", "?", "<i4", "<i4", "<i8", "<i4", "<i4")

    def __init__(self, blob: bytes) -> None:
        self.doc_id, self.named, self.training, self.learning, self.lengths, self.tokens, self.n, ids, sizes = _unpack(blob, *self.KINDS)
        self.words = Words(ids, sizes)
        self.firsts = ids[self.words.begins]
        self.text_of = np.repeat(np.arange(len(self.lengths)), self.lengths)

    @staticmethod
    def pack(marks: tuple[np.ndarray, ...], lengths: np.ndarray, tokens: np.ndarray, n: np.ndarray, words: Words) -> bytes:
        """``tokens`` point into ``n`` and ``words``; only the words that occur are kept."""
        used, own = compact(tokens, len(n))
        kept = words.pick(used)
        return _pack(*(a.astype(kind) for a, kind in zip((*marks, lengths, own, n[used], kept.ids, kept.sizes), Lot.KINDS, strict=True)))

    def before(self, nothing: int) -> tuple[Words, np.ndarray]:
        """The words and ``nothing``, which stands where a text begins, and which of them stands before each token."""
        begins = np.zeros(len(self.tokens), bool)
        begins[np.cumsum(self.lengths) - self.lengths] = True
        return Words(np.append(self.words.ids, nothing), np.append(self.words.sizes, 1)), np.where(begins, len(self.n), np.roll(self.tokens, 1))


def _lots(batches):
    for batch in batches:
        for blob in batch.column("blob"):
            yield Lot(blob.as_py())


def _sums(df: DataFrame, run) -> list[tuple[int, np.ndarray]]:
    """``run``: lots -> (ids, rows of numbers) of a task. Their sums over all tasks, a piece of the ids at a time: its first id and its rows."""

    def of_task(batches):
        for ids, values in run(_lots(batches)):
            for piece in np.unique(ids // PIECE):
                at = ids // PIECE == piece
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([_pack(ids[at].astype("<i4"), values[at].astype("<f4"))], pa.binary())], names=["piece", "blob"])

    def add(_key, table):
        total = None
        for blob in table.column("blob"):
            ids, values = _unpack(blob.as_py(), "<i4", "<f4")
            values = values.reshape(len(ids), -1)
            total = np.zeros((PIECE, values.shape[1])) if total is None else total
            total[ids % PIECE] += values
        return pa.table({"piece": table.column("piece")[:1], "blob": pa.array([_pack(total.astype("<f4"))], pa.binary())})

    parts = df.mapInArrow(of_task, "piece int, blob binary").groupBy("piece").applyInArrow(add, "piece int, blob binary")
    return [(piece * PIECE, _unpack(blob, "<f4")[0].reshape(PIECE, -1)) for piece, blob in parts.collect()]  # the size of the vocabulary


def learned(lots: DataFrame, weights: dict[str, np.ndarray], of: np.ndarray, rate: float, together: int = 64) -> dict[str, np.ndarray]:
    """The weights after every task went over its training texts from the same weights: their mean, each id's by its occurrences."""
    rows, dense = len(weights["e"]), [n for n in weights if n != "e"]
    shared = lots.sparkSession.sparkContext.broadcast((weights, of))

    def run(own):
        weights, of = shared.value
        model, order = Attention.of(weights), np.random.default_rng(9)
        met, tokens = np.zeros(rows), 0
        for lot in own:
            words, at = lot.before(rows - 1)
            places, there, scored = windows(lot.lengths)
            on = lot.learning[lot.text_of[places[:, 0]]]
            places, there, scored = places[on], there[on], scored[on]
            target = of[lot.firsts][lot.tokens]
            shuffled = order.permutation(len(places))
            for s in range(0, len(shuffled), together):
                part = shuffled[s : s + together]
                model.learn(words, at[places[part]], target[places[part]], scored[part].astype(np.float32), rate)
            met += np.bincount(words.ids, np.repeat(np.bincount(at[places[there]], minlength=len(words.sizes)), words.sizes), rows)
            tokens += int(scored.sum())
        ids = np.flatnonzero(met)
        if tokens:
            yield ids, np.concatenate([met[ids][:, None], model.p["e"][ids] * met[ids][:, None]], 1)
            flat = np.concatenate([[1.0], *(model.p[n].ravel() for n in dense)]) * tokens
            yield np.array([-1]), flat[None]

    out = dict(weights, e=weights["e"].copy())
    for start, sums in _sums(lots, run):
        if start < 0:
            flat, at = sums[-1, 1:] / sums[-1, 0], 0
            for n in dense:
                out[n] = flat[at : at + weights[n].size].reshape(weights[n].shape)
                at += weights[n].size
        else:
            met = np.flatnonzero(sums[:, 0])
            out["e"][start + met] = sums[met, 1:] / sums[met, :1]
    shared.destroy()
    return out


def profiles(lots: DataFrame, n_of: np.ndarray) -> np.ndarray:
    """What company each id keeps in the training texts."""
    n_ids = len(n_of)
    common = np.log(max(1, n_of.sum()) / np.maximum(1, n_of)).astype(np.float32)

    def run(own):
        into, signs = np.zeros((n_ids, PROFILE), np.float32), directions(n_ids)
        for lot in own:
            first = lot.firsts[lot.tokens]
            on = lot.learning[lot.text_of] & (first < n_ids)  # not the ends
            if on.any():
                add_profiles(into, first[on], lot.text_of[on], signs, common)
        ids = np.flatnonzero(into.any(1))
        yield ids, into[ids]

    out = np.zeros((-(-n_ids // PIECE) * PIECE, PROFILE), np.float32)
    for start, sums in _sums(lots, run):
        out[start : start + PIECE] = sums
    return out[:n_ids]


def score(docs: DataFrame, is_training: Column, path: str, pattern: str, sample: int | None = None, epochs: int = 2, rate: float = 0.01, block_rows: int = 4096, range_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score). ``is_training``: a condition on doc_id."""
    spark = docs.sparkSession
    rows = documents(docs).withColumn("training", F.coalesce(is_training, F.lit(False)))
    learning = F.col("training")
    if sample is not None:
        last = rows.where("training").select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        learning &= F.xxhash64("doc_id") <= F.lit(last if last is not None else 0)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    ranges = max(1, min(tasks(spark) * 8, -(-int(size or 0) // range_bytes)))
    n_ids = bpe._encoder(path, pattern).n_vocab

    def distinct(batches):
        """Each block's distinct words by range, with their counts in its training texts; under no range its texts as tokens, words numbered in that order."""
        number = TaskContext.get().partitionId() << 33
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        marks, tokens, held = [], [], 0

        def out() -> pa.RecordBatch:
            names, lengths = list(place), np.array([len(t) for t in tokens])
            range_of = np.fromiter((zlib.crc32(w) % ranges for w in names), np.int32, len(names))
            order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
            order = order[np.argsort(range_of[order], kind="stable")]
            new = np.empty(len(names) + 1, np.int32)
            new[order], new[-1] = np.arange(len(names)), len(names)  # the end comes last
            flat = new[np.concatenate(tokens)]
            doc_id, named, training, learning = (np.array(c) for c in zip(*marks, strict=True))
            n = np.bincount(flat[np.repeat(training, lengths)], minlength=len(names) + 1)[:-1]
            starts = np.flatnonzero(np.diff(range_of[order], prepend=-1))
            parts = [(int(range_of[order[a]]), zstandard.compress(b"\n".join([names[i] for i in order[a:z]]), 3), _pack(n[a:z].astype("<i8"))) for a, z in zip(starts, np.append(starts, len(names))[1:], strict=True)]
            parts.append((None, None, _pack(doc_id.astype("<i8"), named, training, learning, lengths.astype("<i4"), flat)))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in parts], pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array([w for _, w, _ in parts], pa.binary()), pa.array([b for _, _, b in parts], pa.binary()), pa.array([int(training.sum())] * len(parts), pa.int64())], names=["range", "block", "words", "blob", "trained"])

        for batch in batches:
            for doc, text, *learns in zip(*(batch.column(c) for c in ("doc_id", "text", "training", "learning")), strict=True):
                w = words(text.as_py())
                tokens.append(np.append(np.fromiter(map(place.__getitem__, w), np.int32, len(w)), np.int32(-1)))
                marks.append((doc.as_py() or 0, doc.is_valid, *(x.as_py() for x in learns)))
                held += len(w) + 1
                if len(marks) == block_rows or held >= BLOCK:
                    yield out()
                    number += 1
                    place.clear()
                    marks, tokens, held = [], [], 0
        if marks:
            yield out()

    parts = stored(rows.withColumn("learning", learning).mapInArrow(distinct, "range int, block long, words binary, blob binary, trained long"))
    trained = parts.where("range is null").agg(F.sum("trained")).first()[0] or 0

    def add_up(_key, table):
        total: dict[bytes, int] = {}
        blobs = [(zstandard.decompress(w).split(b"\n"), _unpack(n, "<i8")[0]) for w, n in zip(table.column("words").to_pylist(), table.column("blob").to_pylist(), strict=True)]
        for w, n in blobs:
            for word, x in zip(w, n.tolist(), strict=True):
                total[word] = total.get(word, 0) + x
        names = list(total)
        own_words = Words(*subwords(names, path, pattern))
        first = own_words.ids[own_words.begins]
        at = {word: i for i, word in enumerate(names)}
        all_n = np.array([total[w] for w in names], np.int64)
        values = []
        for w, _ in blobs:
            own = np.array([at[x] for x in w])
            kept = own_words.pick(own)
            values.append(_pack(all_n[own].astype("<i8"), kept.ids.astype("<i4"), kept.sizes.astype("<i4")))
        known = all_n > 0
        by = _pack(np.bincount(first[known], all_n[known], n_ids).astype("<i8"), np.bincount(first[known], minlength=n_ids).astype("<i8"))
        return pa.table({"range": pa.array([*table.column("range").to_pylist(), None], pa.int32()), "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()), "values": pa.array([*values, by], pa.binary())})

    table = stored(parts.where("range is not null").drop("trained").groupBy("range").applyInArrow(add_up, "range int, block long, values binary"))

    def add_totals(batches):
        sums = np.zeros((2, n_ids), np.int64)
        for batch in batches:
            for blob in batch.column("values").to_pylist():
                sums += np.stack(_unpack(blob, "<i8", "<i8"))
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["id", "n", "kinds"])

    n_of, kinds_of = np.zeros(n_ids, np.int64), np.zeros(n_ids, np.int64)
    for i, n, kinds in table.where("block is null").select("values").mapInArrow(add_totals, "id long, n long, kinds long").groupBy("id").agg(F.sum("n"), F.sum("kinds")).collect():  # a row per subword id
        n_of[i], kinds_of[i] = n, kinds
    total, distinct_n = int(n_of.sum()) + trained, int(kinds_of.sum()) + (trained > 0)
    mass = total + 0.5 * (distinct_n + 1)

    def encode(_key, own, about):
        values = [_unpack(v, "<i8", "<i4", "<i4") for v in about.sort_by("range").column("values").to_pylist()]
        n, ids, sizes = (np.concatenate([*(v[i] for v in values), [last]]) for i, last in enumerate((trained, n_ids, 1)))
        block_words, blobs = Words(ids, sizes), []
        *marks, lengths, tokens = _unpack(own.column("blob")[0].as_py(), *Lot.KINDS[:6])
        ends, at = np.cumsum(lengths), 0
        while at < len(ends):
            since = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, since + LOT, "right")))
            blobs.append(Lot.pack(tuple(m[at:to] for m in marks), lengths[at:to], tokens[since : ends[to - 1]], n, block_words))
            at = to
        return pa.table({"blob": pa.array(blobs, pa.binary())})

    texts = parts.where("range is null").select("block", "blob").groupBy("block")
    lots = stored(texts.cogroup(table.where("block is not null").groupBy("block")).applyInArrow(encode, "blob binary"))
    forget(parts, table)

    of = np.append(word_classes(profiles(lots, n_of), CLASSES), CLASSES)
    counted = class_prior(of, n_of, kinds_of, trained, mass)
    weights = Attention(n_ids + 1, CLASSES + 1).p
    weights["b"] += (counted * np.log(10)).astype(np.float32)  # from the prior, so little data leaves the model near the base
    for epoch in range(epochs if trained else 0):
        weights = learned(lots, weights, of, rate / (1 + epoch))
    shared = spark.sparkContext.broadcast((of, weights))  # the size of the tokenizer's vocabulary times the width
    seen = np.log10(1 - 0.5 / mass) if total else 0.0  # what the model shares out among the classes

    def judge(batches):
        of, weights = shared.value
        model = Attention.of(weights)
        for lot in _lots(batches):
            before, at = lot.before(n_ids + 1)
            vectors, kind = model.vectors(before), of[lot.firsts][lot.tokens]
            n, gain = lot.n[lot.tokens], np.zeros(len(lot.tokens))
            places, _, scored = windows(lot.lengths)
            for w in range(0, len(places), 64):
                part, on = places[w : w + 64], scored[w : w + 64]
                gain[part[on]] = model.gains(vectors[at[part]], kind[part], on)
            gain = np.where(n > 0, gain / np.log(10) + seen - counted[kind], 0.0)
            sums = lambda v: np.bincount(lot.text_of, v, len(lot.lengths))
            base_score = sums(np.log10((n + 0.5) / mass))
            columns = {"doc_id": pa.array(lot.doc_id, mask=~lot.named), "training": pa.array(lot.training), "n_tokens": pa.array(lot.lengths, pa.int64()), "n_known": pa.array(sums(n > 0).astype(np.int64)), "train_tokens": pa.array([total] * len(lot.lengths), pa.int64()), "base_score": pa.array(base_score), "score": pa.array(base_score + sums(gain))}
            yield pa.RecordBatch.from_pydict(columns)

    return lots.mapInArrow(judge, "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
