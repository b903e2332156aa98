"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word is the sum of a hashed word vector and the vectors of its hashed character n-grams. Both
directions of the network run over windows of words; attention pools a window to one logit. The
network is trained with numpy on a bounded sample of labelled texts: a text is toxic if one of its
windows is, so a text's logit is the soft maximum of its windows' (multiple-instance learning).
Scoring runs over all overlapping windows of every whole text and calibrates the largest logit.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.packing import bound_batches, tidy
from peakloom.llm.textblocks import ALNUM_WORDS, Words, blocks, mix, text_bytes

_U = np.uint64
F32 = np.float32
#: n-grams of a word that are added one place after the other for all words at once
MOST_ADDED = 48
#: Bytes of text that are scored together: each distinct word's features are worked out once in them.
SCORED_BYTES = 1 << 22


@dataclass(frozen=True)
class ToxicityConfig:
    """Sizes and bounds. Training looks at max_rows texts of each class, of any length, `epochs` times, by windows `stride` or `window` words apart; of a text with more than top_windows of them at those with the largest logits just then. Scoring takes every window."""

    buckets: int = 1 << 14
    dim: int = 12
    hidden: int = 8
    attention: int = 8
    grams: tuple[int, ...] = (4, 5)
    window: int = 12
    stride: int = 6
    max_rows: int = 1000
    epochs: int = 15
    top_windows: int = 16
    batch: int = 24
    rate: float = 0.01
    seed: int = 11


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def word_features(words: Words, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket of each distinct word, n-gram buckets, the distinct word of each n-gram, distinct word of each word)."""
    _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    return *features_at(words, first, config), inverse.ravel()


def features_at(words: Words, first: np.ndarray, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket of each word that `first` names, n-gram buckets, the word of each n-gram)."""
    starts, ends = words.starts[first], words.ends[first]
    word = (words.hashes[first] % _U(config.buckets)).astype(np.int64)
    # distinct words, with a mark (0) at each end, one after the other
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths + 2)])
    owner = np.repeat(np.arange(len(first)), lengths + 2)
    place = np.arange(bounds[-1]) - bounds[:-1][owner]
    inside = (place > 0) & (place <= lengths[owner])
    letters = np.zeros(bounds[-1], np.uint64)
    letters[inside] = ALNUM_WORDS[1][words.raw[(starts[owner] + place - 1)[inside]]].astype(np.uint64) + _U(1)
    out, owners = [], []
    left = np.repeat(bounds[1:], lengths + 2) - np.arange(bounds[-1])
    for n in config.grams:
        at = np.flatnonzero(left >= n)
        value = np.full(max(len(letters) - n + 1, 0), n, np.uint64)
        for j in range(n):
            value *= _U(0x100000001B3)
            value += letters[j : j + len(value)]
        out.append((mix(value[at]) % _U(config.buckets)).astype(np.int64))
        owners.append(owner[at])
    return word, np.concatenate(out), np.concatenate(owners)


def window_starts(bounds: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of windows that cover every word of each text; a text without words has none."""
    counts = np.diff(bounds)
    windows = np.where(counts > 0, np.maximum(-(-(counts - window) // stride), 0) + 1, 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    return bounds[:-1][owner] + number * stride, owner


class BiGru:
    def __init__(self, config: ToxicityConfig):
        self.config = c = config
        rng = np.random.default_rng(c.seed)
        h2 = 2 * c.hidden
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(F32)
        self.p = {
            "word": draw(c.buckets, c.dim, s=0.05), "gram": draw(c.buckets, c.dim, s=0.05),
            "x": draw(c.dim, 3 * h2, s=0.5), "bx": np.zeros(3 * h2, F32),
            "u": draw(h2, 3 * h2, s=0.3), "a": draw(h2, c.attention, s=0.5), "ba": np.zeros(c.attention, F32),
            "va": draw(c.attention, s=0.5), "o": draw(h2, s=0.5), "bo": np.full(1, -2.0, F32),
        }
        side = np.repeat([0, 1], c.hidden)  # no weight leads from one direction to the other
        self.block = np.tile((side[:, None] == side[None, :]), (1, 3)).astype(F32)
        self.p["u"] *= self.block
        self.scale, self.shift = 1.0, 0.0

    def words(self, features) -> np.ndarray:
        word, gram, owner = features[:3]
        x = self.p["word"].take(word, axis=0)
        # the n-grams of one n stand by word, in runs of sorted owners: words with most of them come first, and
        # their first ones are added, then their second ones, and so on; those of very long words are summed by word
        for s, e in itertools.pairwise([0, *(np.flatnonzero(np.diff(owner) < 0) + 1).tolist(), len(owner)]):
            counts = np.bincount(owner[s:e], minlength=len(x))
            order = np.argsort(-counts, kind="stable")
            down, first = counts[order], (s + np.cumsum(counts) - counts)[order]
            total = np.zeros_like(x)
            for j in range(min(int(counts.max(initial=0)), MOST_ADDED)):
                k = int(np.searchsorted(-down, -j))
                total[:k] += self.p["gram"].take(gram[first[:k] + j], axis=0)
            for i in range(int(np.searchsorted(-down, -MOST_ADDED))):
                total[i] += self.p["gram"][gram[first[i] + MOST_ADDED : first[i] + down[i]]].sum(axis=0)
            x[order] += total
        return x

    def forward(self, xp: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; xp (windows, steps, 3 * 2 * hidden) projected inputs, mask (windows, steps)."""
        c, p = self.config, self.p
        n, steps, _ = xp.shape
        h2, hid = 2 * c.hidden, c.hidden
        ahead = np.ascontiguousarray(xp.transpose(1, 0, 2))
        x = ahead.reshape(steps, n, 3, 2, hid).copy()
        x[:, :, :, 1] = ahead.reshape(steps, n, 3, 2, hid)[::-1, :, :, 1]
        x = x.reshape(steps, n, 3 * h2)
        m = np.empty((steps, n, 2, 1), F32)
        m[:, :, 0, 0], m[:, :, 1, 0] = mask.T, mask.T[::-1]
        m = np.broadcast_to(m, (steps, n, 2, hid)).reshape(steps, n, h2)
        uzr, un = p["u"][:, : 2 * h2], p["u"][:, 2 * h2 :]
        h = np.zeros((n, h2), F32)
        hs = np.empty((steps + 1, n, h2), F32)
        hs[0] = h
        saved = []
        for t in range(steps):
            zr = _sigmoid(x[t, :, : 2 * h2] + h @ uzr)
            z, r = zr[:, :h2], zr[:, h2:]
            hn = h @ un
            new = np.tanh(x[t, :, 2 * h2 :] + r * hn)
            h = h + m[t] * (1 - z) * (new - h)
            hs[t + 1] = h
            if keep:
                saved.append((z, r, hn, new))
        out = np.concatenate([hs[1:, :, :hid], hs[1:][::-1, :, hid:]], axis=2)
        e1 = np.tanh(out @ p["a"] + p["ba"])
        e = e1 @ p["va"]
        e = np.where(mask.T > 0, e, F32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * out).sum(axis=0)
        logit = pooled @ p["o"] + p["bo"][0]
        return (logit, (m, hs, saved, out, e1, a, pooled)) if keep else logit

    def backward(self, d_logit: np.ndarray, cache) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(gradient of xp, gradients of the network's weights)."""
        c, p = self.config, self.p
        m, hs, saved, out, e1, a, pooled = cache
        steps, n, h2 = out.shape
        hid = c.hidden
        g = {"o": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], F32)}
        d_pooled = d_logit[:, None] * p["o"]
        d_out = a[:, :, None] * d_pooled
        d_a = (out * d_pooled).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["va"] = np.einsum("tnk,tn->k", e1, d_e)
        d_e1 = d_e[:, :, None] * p["va"] * (1 - e1 * e1)
        g["a"] = np.tensordot(out, d_e1, axes=([0, 1], [0, 1]))
        g["ba"] = d_e1.sum(axis=(0, 1))
        d_out = d_out + d_e1 @ p["a"].T
        d_hs = np.concatenate([d_out[:, :, :hid], d_out[::-1, :, hid:]], axis=2)
        uzr, un = p["u"][:, : 2 * h2], p["u"][:, 2 * h2 :]
        g["u"] = np.zeros_like(p["u"])
        d_x = np.empty((steps, n, 3 * h2), F32)
        d_h = np.zeros((n, h2), F32)
        for t in range(steps - 1, -1, -1):
            z, r, hn, new = saved[t]
            h = hs[t]
            d_h = d_h + d_hs[t]
            step = m[t] * d_h
            d_new = step * (1 - z) * (1 - new * new)
            d_z = -step * (new - h) * z * (1 - z)
            d_r = d_new * hn * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            d_hn = d_new * r
            d_x[t, :, : 2 * h2], d_x[t, :, 2 * h2 :] = d_zr, d_new
            g["u"][:, : 2 * h2] += h.T @ d_zr
            g["u"][:, 2 * h2 :] += h.T @ d_hn
            d_h = d_h - step * (1 - z) + d_zr @ uzr.T + d_hn @ un.T
        g["u"] *= self.block
        d = d_x.reshape(steps, n, 3, 2, hid)
        back = d.copy()
        back[:, :, :, 1] = d[::-1, :, :, 1]
        return back.reshape(steps, n, 3 * h2).transpose(1, 0, 2), g

    def steps(self, projected: np.ndarray) -> np.ndarray:
        """What a window reads of each row of projected, a row each: of both directions the halved inputs of the gates and that of the new state, then both states after a first step, which starts from nothing."""
        hid, half = self.config.hidden, F32(0.5)
        x = projected.reshape(-1, 3, 2, hid)
        out = np.empty((len(x), 8, hid), F32)
        for d in (0, 1):  # 1 - z is 1/2 + tanh(-x / 2) / 2, r is 1/2 + tanh(x / 2) / 2
            np.multiply(x[:, 0, d], -half, out=out[:, 3 * d])
            np.multiply(x[:, 1, d], half, out=out[:, 3 * d + 1])
            out[:, 3 * d + 2] = x[:, 2, d]
            out[:, 6 + d] = (half + half * np.tanh(out[:, 3 * d])) * np.tanh(x[:, 2, d])
        return out.reshape(len(x), 8 * hid)

    def projected(self, steps: np.ndarray) -> np.ndarray:
        """The rows of projected that gave these rows of steps; factors of two are exact."""
        hid = self.config.hidden
        x = steps[:, : 6 * hid].reshape(len(steps), 2, 3, hid) * np.array([-2, 2, 1], F32)[:, None]
        return x.transpose(0, 2, 1, 3).reshape(len(steps), 6 * hid)

    def full_logits(self, projected: np.ndarray, of: np.ndarray | None = None, most: int = 1960) -> np.ndarray:
        """Logits of all runs of `window` consecutive steps, as forward gives them without a mask; step k reads projected[of[k]], or projected[k]."""
        return self.window_logits(self.steps(projected), np.arange(len(projected)) if of is None else of, most)

    def window_logits(self, table: np.ndarray, of: np.ndarray, most: int = 1960) -> np.ndarray:
        """full_logits from rows of steps.

        Features lie in the first axis, a column is a window. Windows one step apart read the same rows: what all
        windows read at step t begins t later in memory, so every array has the columns of a chunk's words, each
        operation is one over a run of memory, and the last `window` - 1 columns, which run into the next feature, are
        dropped. `most` windows a chunk keep it in the cache. Products are taken in parts so small that BLAS does
        not share them with threads that would wait busily.
        """
        c, p = self.config, self.p
        hid, att, width, half = c.hidden, c.attention, c.window, F32(0.5)
        n = len(of) - width + 1
        if n <= 0:
            return np.zeros(0, F32)
        u = p["u"].reshape(2, hid, 3, 2, hid)
        heads = np.concatenate([p["a"], p["o"][:, None]], axis=1).T.reshape(att + 1, 2, hid)
        turns = []  # a direction's rows of the gates, of the new state, of the attention's layer, of the read-out
        for d in (0, 1):
            turn = u[d, :, :, d].reshape(hid, 3 * hid).T * half  # r * v is v / 2 + tanh(x / 2) * v / 2
            turn[:hid] *= -1
            turns.append(np.ascontiguousarray(np.concatenate([turn, heads[:, d]]), F32))
        out = np.empty(n, F32)
        pitch = 0
        for s in range(0, n, most):
            m = min(most, n - s)
            if m + width - 1 != pitch:
                pitch = m + width - 1
                memory = np.zeros(8 * hid * pitch + width, F32)
                rows = np.empty((pitch, 8 * hid), F32)
                read = memory[: 8 * hid * pitch].reshape(8 * hid, pitch)
                inputs = [[(memory[k : k + 2 * hid * pitch], memory[k + 2 * hid * pitch : k + 3 * hid * pitch]) for k in range(at, at + width)] for at in (0, 3 * hid * pitch)]
                first = [memory[k : k + hid * pitch].reshape(hid, pitch) for k in (6 * hid * pitch, 7 * hid * pitch + width - 1)]
                turned = np.empty((3 * hid + att + 1, pitch), F32)
                flat = turned.reshape(-1)
                gates, take, reset, new, head = (flat[i * pitch : j * pitch] for i, j in ((0, 2 * hid), (0, hid), (hid, 2 * hid), (2 * hid, 3 * hid), (3 * hid, 3 * hid + att + 1)))
                layer = turned[3 * hid : 3 * hid + att]
                state = np.empty((hid, pitch), F32)
                ahead = np.empty((width, (att + 1) * pitch), F32)
                weights, total = np.empty((width, pitch), F32), np.empty((width, pitch), F32)
                share = max(1, min((1 << 18) // (len(turned) * hid), (1 << 13) // att))
                parts = [slice(k, k + share) for k in range(0, pitch, share)]
                bias = np.repeat(np.append(p["ba"], F32(0)), pitch)
            read[:] = table.take(of[s : s + pitch], axis=0, out=rows, mode="clip").T
            for d in (0, 1):
                h = first[d]
                for k in range(width):
                    # the product with a state serves the step after it and, of that state itself, the pooling
                    t = k if d == 0 else width - 1 - k
                    if k:
                        gates += inputs[d][t][0]
                        np.tanh(gates, out=gates)
                        reset *= new
                        new += reset
                        new += inputs[d][t][1]
                        np.tanh(new, out=new)
                        new -= h.reshape(-1)
                        take *= half
                        take += half
                        take *= new
                        h = np.add(h, turned[:hid], out=state)
                    for part in parts:
                        np.matmul(turns[d], h[:, part], out=turned[:, part])
                    if d == 0:
                        np.add(head, bias, out=ahead[t])
                    else:
                        head += ahead[t]
                        total[t] = turned[-1]
                        np.tanh(layer, out=layer)
                        for part in parts:
                            np.matmul(p["va"][None], layer[:, part], out=weights[t : t + 1, part])
            weights -= weights.max(axis=0)
            np.exp(weights, out=weights)
            total *= weights
            out[s : s + m] = (total.sum(axis=0) / weights.sum(axis=0))[:m]
        return out + p["bo"][0]

    def text_logits(self, words: Words, known: KnownWords | None = None) -> np.ndarray:
        """The largest logit of all windows, one a word apart, of each text; -inf for texts without words."""
        c = self.config
        best = np.full(len(words.bounds) - 1, -np.inf)
        if not len(words.hashes):
            return best
        known = known or KnownWords(self)
        of = known.rows(words)
        starts, owner = window_starts(words.bounds, c.window, 1)
        last = words.bounds[1:][owner]
        full = starts + c.window <= last
        if full.any():
            texts, edge = np.unique(owner[full], return_index=True)
            best[texts] = np.maximum.reduceat(self.window_logits(known.table, of)[starts[full]], edge)
        starts, owner, last = starts[~full], owner[~full], last[~full]  # of texts shorter than a window
        for s in range(0, len(starts), 512):
            at = starts[s : s + 512, None] + np.arange(c.window)
            mask = at < last[s : s + 512, None]
            xp = self.projected(known.table[of[np.minimum(at, len(of) - 1)].ravel()]).reshape(*at.shape, -1)
            np.maximum.at(best, owner[s : s + 512], self.forward(xp, mask.astype(F32)))
        return best

    def scores(self, column, known: KnownWords | None = None) -> np.ndarray:
        """Calibrated scores of all texts of an Arrow column; a text without words gets the score of logit `empty`."""
        raw, offsets = text_bytes(column)
        known = known or KnownWords(self)
        out = [self.text_logits(Words(raw, offsets[i : j + 1], ALNUM_WORDS), known) for i, j in blocks(offsets, SCORED_BYTES)]
        logit = np.concatenate(out) if out else np.zeros(0)
        logit = np.where(np.isfinite(logit), logit, -20.0)
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


class KnownWords:
    """A net's rows of steps of the words met so far, by their hashes, from batch to batch.

    When it would hold more than `most`, only the words of this call and, if they fit, those that more than one call
    has met stay; the words of one call are always held together.
    """

    def __init__(self, net: BiGru, most: int = 1 << 18):
        self.net, self.most = net, most
        self.table = np.empty((0, 8 * net.config.hidden), F32)
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # the hashes sorted, and the row of each
        self.again = np.zeros(0, bool)

    def _find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash among those held, whether it is there)."""
        place = np.searchsorted(self.hashes, distinct)
        if not len(self.hashes):
            return place, np.zeros(len(distinct), bool)
        place = np.minimum(place, len(self.hashes) - 1)
        return place, self.hashes[place] == distinct

    def _keep_again(self) -> None:
        stay = self.again if np.count_nonzero(self.again) <= self.most else np.zeros(len(self.again), bool)
        rows = self.table[self.at[stay]]
        self.hashes, self.at, self.again = self.hashes[stay], np.arange(len(rows)), np.zeros(len(rows), bool)
        if len(self.table) > self.most:
            self.table = np.empty((self.most, self.table.shape[1]), F32)
        self.table[: len(rows)] = rows

    def rows(self, words: Words) -> np.ndarray:
        """The row of table of each word."""
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        place, here = self._find(distinct)
        self.again[place[here]] = True
        for _ in range(2):  # at the second time none are left that were met again
            if len(self.hashes) and len(self.hashes) + np.count_nonzero(~here) > self.most:
                self._keep_again()
                place, here = self._find(distinct)
        have, new = len(self.hashes), np.count_nonzero(~here)
        if have + new > len(self.table):  # only if it holds nothing
            self.table = np.empty((max(self.most, new), self.table.shape[1]), F32)
        if new:
            vectors = self.net.words(features_at(words, first[~here], self.net.config))
            for s in range(0, new, 256):
                self.table[have + s : have + min(s + 256, new)] = self.net.steps(vectors[s : s + 256] @ self.net.p["x"] + self.net.p["bx"])
            hashes = np.concatenate([self.hashes, distinct[~here]])
            order = np.argsort(hashes)
            self.hashes, self.at = hashes[order], np.concatenate([self.at, np.arange(have, have + new)])[order]
            self.again = np.concatenate([self.again, np.zeros(new, bool)])[order]
            place = np.searchsorted(self.hashes, distinct)
        return self.at[place][inverse.ravel()]


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on x, by Newton steps with a small ridge; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, v = w * (p - y), w * p * (1 - p)
        g = np.array([(r * x).sum() + 1e-2 * (a - 1), r.sum() + 1e-2 * b])
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 0.05), b


def _top(net: BiGru, projected: np.ndarray, distinct: np.ndarray, at: np.ndarray, mask: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """The windows to learn from: all of a text with up to `most`, else those with the largest logits, which carry the soft maximum."""
    many = np.bincount(owner) > most
    long = np.flatnonzero(many[owner])
    if not len(long):
        return np.arange(len(owner))
    logit = np.concatenate([net.forward(projected[distinct[np.minimum(at[p], len(distinct) - 1)]], mask[p]) for p in (long[s : s + 512] for s in range(0, len(long), 512))])
    order = np.lexsort((-logit, owner[long]))
    of = owner[long][order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    return np.sort(np.concatenate([np.flatnonzero(~many[owner]), long[order[place < most]]]))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, config: ToxicityConfig | None = None) -> BiGru:
    """Fit on texts; every fifth is held back for the calibration. weights undo uneven sampling there."""
    c = config or ToxicityConfig()
    net = BiGru(c)
    labels = np.asarray(labels, F32)
    rng = np.random.default_rng(c.seed + 1)
    held = np.arange(len(texts)) % 5 == 0
    if not len(texts) or labels.min() == labels.max():
        net.shift = 4.0 if len(texts) and labels.max() > 0 else -4.0
        net.scale = 0.0
        return net
    use = np.flatnonzero(~held)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    share = max(labels[use].mean(), 1e-3)
    for epoch in range(c.epochs):
        rng.shuffle(use)
        for s in range(0, len(use), c.batch):
            part = use[s : s + c.batch]
            raw, offsets = text_bytes(pa.array([texts[i] for i in part], pa.string()))
            words = Words(raw, offsets, ALNUM_WORDS)
            if not len(words.hashes):
                continue
            features = word_features(words, c)
            vectors = net.words(features)
            projected = vectors @ net.p["x"] + net.p["bx"]
            starts, owner = window_starts(words.bounds, c.window, c.window if epoch % 2 else c.stride)
            at = starts[:, None] + np.arange(c.window)
            mask = (at < words.bounds[1:][owner][:, None]).astype(F32)
            if len(keep := _top(net, projected, features[3], at, mask, owner, c.top_windows)) < len(owner):
                at, mask, owner = at[keep], mask[keep], owner[keep]
            at = features[3][np.minimum(at, len(words.hashes) - 1)]
            logit, cache = net.forward(projected[at], mask, keep=True)
            top = np.full(len(part), -np.inf, F32)
            np.maximum.at(top, owner, logit)
            soft = np.exp(logit - top[owner])
            total = np.bincount(owner, soft, len(part))
            has = total > 0
            text_logit = np.where(has, top + np.log(np.maximum(total, 1e-9)), 0)
            y = labels[part]
            d = (1 / (1 + np.exp(-text_logit)) - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * has / len(part)
            d_logit = (d[owner] * soft / np.maximum(total, 1e-9)[owner]).astype(F32)
            d_xp, g = net.backward(d_logit, cache)
            d_xp *= mask[:, :, None]
            flat, rows = d_xp.reshape(-1, d_xp.shape[2]), at.ravel()
            order = np.argsort(rows, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) > 0]))
            d_proj = np.zeros_like(projected)
            d_proj[rows[order][edge]] = np.add.reduceat(flat[order], edge, axis=0)
            g["x"], g["bx"] = vectors.T @ d_proj, d_proj.sum(axis=0)
            d_vec = d_proj @ net.p["x"].T
            word, gram, gram_owner, _ = features
            g["word"] = np.stack([np.bincount(word, d_vec[:, k], c.buckets) for k in range(c.dim)], axis=1).astype(F32)
            spread = d_vec[gram_owner]
            g["gram"] = np.stack([np.bincount(gram, spread[:, k], c.buckets) for k in range(c.dim)], axis=1).astype(F32)
            step += 1
            for k, (m1, m2) in moment.items():
                m1 *= 0.9
                m1 += F32(0.1) * g[k]
                m2 *= 0.999
                m2 += F32(0.001) * g[k] * g[k]
                net.p[k] -= F32(c.rate) * (m1 / F32(1 - 0.9**step)) / (np.sqrt(m2 / F32(1 - 0.999**step)) + F32(1e-6))
    check = np.flatnonzero(held) if labels[held].min() < labels[held].max() else np.arange(len(texts))
    raw, offsets = text_bytes(pa.array([texts[i] for i in check], pa.string()))
    logit = np.concatenate([net.text_logits(Words(raw, offsets[i : j + 1], ALNUM_WORDS)) for i, j in blocks(offsets, SCORED_BYTES)])
    logit = np.where(np.isfinite(logit), logit, -20.0)
    net.scale, net.shift = _platt(logit, labels[check], np.asarray(weights)[check])
    return net


def training_sample(docs: DataFrame, labels: DataFrame, config: ToxicityConfig, *, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most max_rows labelled texts of each class, the first by a hash of the id; only ids whose crc32 mod 3 is not 1."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(config.max_rows) for y in (0, 1)]
    ids = parts[0].union(parts[1])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(ids), "id").collect()
    rows = sorted(rows, key=lambda r: (hash((r["id"] * 2654435761) & 0xFFFFFFFF), r["id"]))
    y = np.array([r["y"] for r in rows], F32)
    counts = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weights = np.array([totals.get(r["y"], 0) / counts[r["y"]] for r in rows])
    return [r["text"] for r in rows], y, weights / max(weights.mean(), 1e-9) if len(weights) else weights


def score_toxicity(docs: DataFrame, net: BiGru, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, the probability that a text is toxic, over all overlapping windows of the whole text.

    Null and empty texts and those without words get the score of a very low logit. Rows pass through,
    repeated ones too; a column named score_col is replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text_col, score_col)]
    df = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(0.0).alias(score_col)).schema

    @tidy
    def run(batches):
        known = KnownWords(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.scores(b.column(b.num_columns - 1), known), pa.float64())], names=[*keep, score_col])

    return df.mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    config = ToxicityConfig()
    net = train(*training_sample(docs, labels, config, id_col="doc_id", text_col="text", label_col="toxic"), config)
    scored = score_toxicity(docs, net)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
