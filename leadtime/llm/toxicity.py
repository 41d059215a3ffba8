"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .labelled import held_out, sampled
from .shingles import _P, _power_table, chunks, mix, text_bytes, word_spans

#: Words of a window, and from one window's start to the next in training; texts are scored at every start.
WINDOW, STRIDE = 32, 16
#: Words that a run of the network covers in a text that is scored, and words read before them, from either side.
SEGMENT, WARM = 96, 32
#: Runs computed at a time, and distinct words whose inputs a worker remembers, about 200 bytes each.
BLOCK, MEMO = 4096, 200_000
GRAMS = (3, 4, 5)
WIDTH, HIDDEN = 12, 8
#: Embeddings shrink by this share a step when touched.
DECAY = 0.004
#: A logit for texts without words.
NO_WORDS = -12.0

_SPLIT = np.ones(256, bool)
_SPLIT[48:58] = _SPLIT[65:91] = _SPLIT[97:123] = _SPLIT[128:] = False


@dataclass
class Words:
    """The distinct words of some texts: hashes, and hashes of their character n-grams with len+1 offsets."""

    hashes: np.ndarray
    grams: np.ndarray
    at: np.ndarray


def _distinct(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the first byte and the length of one occurrence each, which of them each word is, and len+1 offsets of each text's words."""
    hashes, starts, ends, at = word_spans(raw, offsets, _SPLIT)
    own, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return own, starts[first], (ends - starts)[first], which, at


def _grams(raw: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of words, and len+1 offsets of each word's."""
    size = size + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    byte = np.full(begin[-1], ord("<"), np.uint64)
    inner = np.repeat(lo - begin[:-1] - 1, size) + np.arange(begin[-1])
    edge = np.zeros(begin[-1], bool)
    edge[begin[:-1]] = True
    edge[begin[1:] - 1] = True
    inside = ~edge
    letters = raw[inner[inside]].astype(np.uint64)
    letters[(letters >= 65) & (letters <= 90)] += np.uint64(32)
    byte[inside] = letters
    byte[begin[1:] - 1] = ord(">")
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    left = np.repeat(begin[1:], size) - np.arange(begin[-1])
    power = _power_table(_P, 16)
    found, owners = [], []
    for n in GRAMS:
        fits = np.flatnonzero(left >= n)
        total = np.zeros(len(fits), np.uint64)
        for k in range(n):
            total += byte[fits + k] * power[k]
        found.append(mix(total + np.uint64(n)))
        owners.append(owner[fits])
    grams, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.searchsorted(owners[order], np.arange(len(size) + 1))


def read_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Distinct words, which of them each word of the texts is, and len+1 offsets of each text's words."""
    own, lo, size, which, at = _distinct(raw, offsets)
    return Words(own, *_grams(raw, lo, size)), which, at


def windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of every window of every text; windows overlap by WINDOW - STRIDE and cover all words."""
    n = np.diff(at)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = np.where(n[text] > WINDOW, np.minimum(nth * STRIDE, n[text] - WINDOW), 0)
    return at[:-1][text] + first, np.minimum(n[text], WINDOW), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights; embeddings are kept for words and n-grams seen in training only, keyed by their hashes."""

    words: np.ndarray
    grams: np.ndarray
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    history: list[float] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def rows(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding row of each word (0: unknown), of each known n-gram, and len+1 offsets of the latter."""
        word = _known(self.words, w.hashes)
        gram = _known(self.grams, w.grams)
        some = gram > 0
        count = np.concatenate([[0], np.cumsum(some)])[w.at]
        return word, gram[some], count

    def inputs(self, word: np.ndarray, gram: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A word's vector plus its n-grams' vectors, summed and divided by the root of their number."""
        x = self.p["word"][word]
        n = np.diff(at)
        has = np.flatnonzero(n)
        if len(has):
            x = x.copy()
            x[has] += np.add.reduceat(self.p["gram"][gram], at[has], axis=0) / np.sqrt(n[has, None])
        return x

    def logits(self, w: Words, which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logit, text) of every training window, each read alone."""
        first, size, text = windows_of(at)
        x = self.inputs(*self.rows(w)) if len(w.hashes) else np.zeros((0, WIDTH), np.float32)
        gates = [np.concatenate([x @ self.p["W" + k] + self.p["b" + k], np.zeros((1, 3 * HIDDEN), np.float32)]) for k in "fb"]
        out = np.zeros(len(first), np.float32)
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(first), BLOCK):
            pick = order[lo : lo + BLOCK]
            steps = int(size[pick].max())
            place = first[pick, None] + np.arange(steps)
            live = np.arange(steps) < size[pick, None]
            ids = np.where(live, which[np.minimum(place, len(which) - 1)], len(x))
            states = np.empty((steps, len(pick), 2 * HIDDEN), np.float32)
            full = bool(live.all())
            for k, own, gate in (("f", slice(0, HIDDEN), gates[0]), ("b", slice(HIDDEN, 2 * HIDDEN), gates[1])):
                u, h = self.p["U" + k], np.zeros((len(pick), HIDDEN), np.float32)
                for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
                    new = _step(gate[ids[:, t]], h, u)
                    h = new if full else np.where(live[:, t, None], new, h)
                    states[t, :, own] = h
            weight = states @ self.p["v"]
            weight[~live.T] = -1e9
            weight = np.exp(weight - weight.max(0))
            weight /= weight.sum(0)
            out[pick] = np.einsum("tb,tbh->bh", weight, states) @ self.p["w"] + self.p["c"][0]
        return out, text

    def gates(self, raw: np.ndarray, own: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What distinct words add to the gates of both directions; those of the last words are remembered."""
        known, rows = self.__dict__.get("memo") or (np.zeros(0, np.uint64), np.zeros((0, 6 * HIDDEN), np.float32))
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        new = np.flatnonzero(known[at] != own) if len(known) else np.arange(len(own))
        x = self.inputs(*self.rows(Words(own[new], *_grams(raw, lo[new], size[new])))) if len(new) else np.zeros((0, WIDTH), np.float32)
        out = np.empty((len(own), 6 * HIDDEN), np.float32)
        if len(known):
            out[:] = rows[at]
        for d, k in enumerate("fb"):
            out[new, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)] = x @ self.p["W" + k] + self.p["b" + k]
        if len(known) + len(new) > MEMO:
            self.memo = (own, out)
        elif len(new):
            both, place = np.unique(np.concatenate([known, own[new]]), return_index=True)
            self.memo = (both, np.concatenate([rows, out[new]])[place])
        return out

    def word_values(self, gates: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each word what its state gives to the attention and to the logit.

        A text is covered by runs of SEGMENT words; a run reads up to WARM words before and, backwards, after its own.
        """
        n = np.diff(at)
        count = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), count)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        own, left = np.minimum(n[text] - first, SEGMENT), np.minimum(first, WARM)
        right = np.minimum(n[text] - first - own, WARM)
        first = first + at[:-1][text]
        out, order = np.zeros((len(which), 2), np.float32), np.lexsort((own + right, left))
        heads = [np.stack([self.p["v"][part], self.p["w"][part]], 1) for part in (slice(0, HIDDEN), slice(HIDDEN, 2 * HIDDEN))]
        for lo in range(0, len(order), BLOCK):
            pick = order[lo : lo + BLOCK]
            f, m, l, r = first[pick], own[pick], left[pick], right[pick]
            for k, steps, live_at in (("f", range(-int(l.max()), int(m.max())), lambda t: (t >= -l) & (t < m)), ("b", range(int((m + r).max()) - 1, -1, -1), lambda t: t < m + r)):
                d = "fb".index(k)
                part, u, h = gates[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)], self.p["U" + k], np.zeros((len(pick), HIDDEN), np.float32)
                for t in steps:
                    live = live_at(t)
                    full = bool(live.all())
                    place = f + t if full else np.where(live, f + t, f)
                    new = _step(part[which[place]], h, u)
                    h = new if full else np.where(live[:, None], new, h)
                    if t >= 0:
                        mine = t < m
                        out[f[mine] + t] += (h if mine.all() else h[mine]) @ heads[d]
        return out

    def text_logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest logit of all windows of each text, one at every start: attention pools the states of the window's words."""
        own, lo, size, which, at = _distinct(raw, offsets)
        best = np.full(len(offsets) - 1, NO_WORDS, np.float32)
        if not len(which):
            return best
        values = self.word_values(self.gates(raw, own, lo, size), which, at).astype(np.float64)
        n = np.diff(at)
        text = np.repeat(np.arange(len(n)), n)
        spread = np.arange(len(which)) + WINDOW * text  # after each text, WINDOW words without weight
        sums = np.zeros((2, len(which) + WINDOW * len(n)))
        weight = np.exp(values[:, 0] - values[:, 0].max())
        sums[0, spread], sums[1, spread] = weight, weight * values[:, 1]
        width = 1
        while width < WINDOW:
            sums[:, :-width] += sums[:, width:].copy()
            width *= 2
        starts = np.arange(len(which)) - at[:-1][text] <= np.maximum(n - WINDOW, 0)[text]
        spread, text = spread[starts], text[starts]
        logit = sums[1, spread] / np.maximum(sums[0, spread], 1e-300) + self.p["c"][0]
        some = np.flatnonzero(n)
        best[some] = np.maximum.reduceat(logit, np.searchsorted(text, some))
        return best

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated chance of label 1 of each text of a string column."""
        raw, offsets = text_bytes(column)
        out = [np.zeros(0)]
        for lo, hi in chunks(offsets):
            part = offsets[lo : hi + 1]
            best = self.text_logits(raw[part[0] : part[-1]], part - part[0])
            out.append(_sigmoid(np.clip(self.slope * best.astype(np.float64) + self.offset, -40, 40)))
        return np.concatenate(out)


def _step(gate: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    hu = h @ u
    zr = _sigmoid(gate[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
    n = np.tanh(gate[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * hu[:, 2 * HIDDEN :])
    z = zr[:, :HIDDEN]
    return n + z * (h - n)


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1-based place in a sorted table, 0 where absent."""
    if not len(table):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at + 1, 0)


def _forward_backward(p: dict, x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Mean weighted log loss of a batch (batch, step, width), gradients of the weights and of x."""
    batch, steps, _ = x.shape
    H, kept, states = HIDDEN, {}, np.zeros((batch, steps, 2 * HIDDEN), np.float32)
    for k, own in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
        gate, h, trace = x @ p["W" + k] + p["b" + k], np.zeros((batch, H), np.float32), []
        for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
            hu = h @ p["U" + k]
            z, r = _sigmoid(gate[:, t, :H] + hu[:, :H]), _sigmoid(gate[:, t, H : 2 * H] + hu[:, H : 2 * H])
            n = np.tanh(gate[:, t, 2 * H :] + r * hu[:, 2 * H :])
            m = live[:, t, None]
            trace.append((t, h, z, r, n, hu[:, 2 * H :], m))
            h = np.where(m, n + z * (h - n), h)
            states[:, t, own] = h
        kept[k] = trace
    s = np.where(live, states @ p["v"], -1e9)
    a = np.exp(s - s.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    pooled = np.einsum("bt,bth->bh", a, states)
    q = _sigmoid(pooled @ p["w"] + p["c"][0])
    loss = -float((weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).mean())
    d = (weight * (q - y) / batch).astype(np.float32)
    g = {"w": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["w"]
    ds = a * (np.einsum("bh,bth->bt", dp, states) - (dp * pooled).sum(1, keepdims=True))
    g["v"] = np.einsum("bt,bth->h", ds, states)
    dstates = a[:, :, None] * dp[:, None] + ds[:, :, None] * p["v"]
    dx = np.zeros_like(x)
    for k, own in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
        dgate, carry, du = np.zeros((batch, steps, 3 * H), np.float32), np.zeros((batch, H), np.float32), np.zeros_like(p["U" + k])
        for t, before, z, r, n, hun, m in reversed(kept[k]):
            dh = dstates[:, t, own] + carry
            new = np.where(m, dh, 0)
            an = new * (1 - z) * (1 - n * n)
            az, ar = new * (before - n) * z * (1 - z), an * hun * r * (1 - r)
            dgate[:, t] = np.concatenate([az, ar, an], 1)
            dhu = np.concatenate([az, ar, an * r], 1)
            du += before.T @ dhu
            carry = new * z + dhu @ p["U" + k].T + np.where(m, 0, dh)
        g["U" + k] = du
        g["W" + k] = np.einsum("btd,btg->dg", x, dgate)
        g["b" + k] = dgate.sum((0, 1))
        dx += dgate @ p["W" + k].T
    return loss, g, dx


def _signal(w: Words, which: np.ndarray, at: np.ndarray, y: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word how surely it or one of its n-grams goes with label 1, in standard deviations, and how many texts hold each word and n-gram."""
    held = np.zeros((2, len(w.hashes)), np.int32), np.zeros((2, size), np.int32)
    per = np.diff(w.at)
    for d in range(len(y)):
        words = np.unique(which[at[d] : at[d + 1]])
        held[0][y[d], words] += 1
        n = per[words]
        flat = np.repeat(w.at[:-1][words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        held[1][y[d], np.unique(ids[flat])] += 1
    share = y.mean()
    word, gram = ((h[1] - share * h.sum(0)) / np.sqrt(share * (1 - share) * np.maximum(h.sum(0), 1)) for h in held)
    return np.maximum(word, np.maximum.reduceat(gram[ids], w.at[:-1])), held[0].sum(0), held[1].sum(0)


def fit(rows: list[tuple[str, int]], share: float | None = None, steps: int = 400, batch: int = 192, rate: float = 0.012, seed: int = 5) -> Network:
    """Train on windows of labelled texts; ``share`` is that of label 1 at large, for calibration.

    A text's label says little about most of its windows. So of a text of label 1 the window that holds the word of the strongest
    signal is learnt as 1, and of a text of label 0 that window and a random one as 0. Every fourth text is kept for
    calibrating the largest logit of whole texts. Without texts of both labels every score is ``share`` (or 0.5).
    """
    rng = np.random.default_rng(seed)
    y = np.array([label for _, label in rows])
    base = 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)
    tune = np.zeros(len(rows), bool)
    for label in (0, 1):
        tune[np.flatnonzero(y == label)[::4]] = True
    if any(len(set(y[part].tolist())) < 2 for part in (tune, ~tune)):
        zero = {k: np.zeros(s, np.float32) for k, s in _shapes(0, 0).items()}
        return Network(np.zeros(0, np.uint64), np.zeros(0, np.uint64), zero, 0.0, float(np.log(base / (1 - base))))
    texts = [t for (t, _), kept in zip(rows, tune) if not kept]
    label = y[~tune]
    w, which, at = read_words(*text_bytes(pa.array(texts, pa.large_string())))
    grams, gram_id = np.unique(w.grams, return_inverse=True)
    gram_id = gram_id.astype(np.int32)
    best, word_in, gram_in = _signal(w, which, at, label, gram_id, len(grams))
    net = Network(w.hashes[word_in >= 3], grams[gram_in >= 4], {})
    net.p = {k: (rng.normal(size=s) * (0.3 if len(s) == 2 else 0.1)).astype(np.float32) for k, s in _shapes(len(net.words), len(net.grams)).items()}
    for k in ("word", "gram"):
        net.p[k] *= 0.2
        net.p[k][0] = 0

    first, size, text = windows_of(at)
    place = first[:, None] + np.arange(WINDOW)
    live = np.arange(WINDOW) < size[:, None]
    ids = np.where(live, which[np.minimum(place, len(which) - 1)], -1)
    signal = np.where(live, best[ids], -99)
    top, top_at = signal.max(1), signal.argmax(1)
    order = np.lexsort((-top, text))
    lead = order[np.unique(text[order], return_index=True)[1]]
    chance = np.array([rng.integers(*np.searchsorted(text, [t, t + 1])) for t in text[lead]])
    clean = np.flatnonzero(label[text] == 0)
    pick = np.concatenate([lead, chance[label[text[lead]] == 0], rng.permutation(clean)[: 2 * len(lead)]])
    rows_word, rows_gram, rows_at = net.rows(w)
    batch = max(16, min(batch, len(pick) // 12))
    epochs = max(6, -(-steps // max(1, len(pick) // batch)))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch == epochs // 2:  # the clean windows that the network so far holds for toxic
            logit, _ = net.logits(w, which, at)
            pick = np.concatenate([pick, clean[np.argsort(-logit[clean])[: len(lead)]]])
        target = label[text[pick]].astype(np.float32)
        weight = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())).astype(np.float32)
        total = 0.0
        shuffled = rng.permutation(len(pick))
        for lo in range(0, len(shuffled), batch):
            some = shuffled[lo : lo + batch]
            win = ids[pick[some]]
            # half of the windows of label 1 keep their leading word and its neighbours only, among words of a clean window
            moved = (target[some] == 1) & (rng.random(len(some)) < 0.5)
            near = np.abs(np.arange(WINDOW) - top_at[pick[some]][:, None]) < 2
            win = np.where(moved[:, None] & ~near, ids[rng.choice(clean, len(some))], win)
            own, inside = np.unique(win, return_inverse=True)
            pad = int(own[0] == -1)
            used = own[pad:]
            n = np.diff(rows_at)[used]
            sub_at = np.concatenate([[0], np.cumsum(n)])
            sub = rows_gram[np.repeat(rows_at[:-1][used] - sub_at[:-1], n) + np.arange(sub_at[-1])]
            as_word = np.where(rng.random(len(used)) < 0.25, 0, rows_word[used])  # else characters would not be learnt
            x = net.inputs(as_word, sub, sub_at)
            x = np.concatenate([np.zeros((pad, WIDTH), np.float32), x])
            inside = inside.reshape(win.shape)
            loss, g, dx = _forward_backward(net.p, x[inside], win >= 0, target[some], weight[some])
            total += loss * len(some)
            dword = np.zeros_like(x)
            np.add.at(dword, inside.ravel(), dx.reshape(-1, WIDTH))
            dword = dword[pad:]
            touched = {"word": as_word, "gram": np.unique(sub)}
            g["word"], g["gram"] = dword, np.zeros((len(touched["gram"]), WIDTH), np.float32)
            np.add.at(g["gram"], np.searchsorted(touched["gram"], sub), np.repeat(dword / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0))
            g["word"][touched["word"] == 0] = 0
            step += 1
            now = rate * min(1, step / 30) * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.05)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():  # Adam; of the embeddings only the rows that the batch touched
                v = v * min(1.0, 5 / (norm + 1e-9))
                own = touched.get(k, slice(None))
                m, q = moments[k]
                m[own] += 0.1 * (v - m[own])
                q[own] += 0.001 * (v * v - q[own])
                if k in touched:
                    net.p[k][own] *= 1 - DECAY * now / rate
                net.p[k][own] -= (now * (m[own] / (1 - 0.9**step)) / (np.sqrt(q[own] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.p["word"][0] = 0
        net.history.append(total / len(pick))
    logit = net.text_logits(*text_bytes(pa.array([t for (t, _), kept in zip(rows, tune) if kept], pa.large_string()))).astype(np.float64)
    net.slope, net.offset = _calibrated(logit, y[tune].astype(np.float64), base)
    return net


def _shapes(words: int, grams: int) -> dict[str, tuple[int, ...]]:
    H = HIDDEN
    one = {f"{k}{d}": s for d in "fb" for k, s in (("W", (WIDTH, 3 * H)), ("U", (H, 3 * H)), ("b", (3 * H,)))}
    return {"word": (words + 1, WIDTH), "gram": (grams + 1, WIDTH), **one, "v": (2 * H,), "w": (2 * H,), "c": (1,)}


def _calibrated(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic slope and offset with the labels weighed to ``share``; smoothed targets keep them finite where the labels separate."""
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    middle, scale = x.mean(), x.std() + 1e-6
    z, w = np.stack([(x - middle) / scale, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = z.T @ (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]) + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, z.T @ (weight * (p - soft))), -0.5, 0.5)
    slope = max(w[0], 0.05) / scale
    return float(slope), float(w[1] - slope * middle)


def train(documents: DataFrame, labels: DataFrame, most: tuple[int, int] = (1600, 800), **settings) -> Network:
    """Fit on labelled rows that are not held out, at most ``most`` of label 0 and of label 1.

    The bounded sample is gathered in one task, whose worker trains; only the weights come to the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg("toxic")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "y"))))
        network = fit([(text, y) for _, text, y in rows], share, **settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], ["network"])

    chosen = materialize(sampled(documents, labels, "toxic", most), "sample")
    return pickle.loads(chosen.coalesce(1).mapInArrow(run, "network binary").first()["network"])


def scores(documents: DataFrame, network: Network, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: the score of the worst of all overlapping windows of the whole text.

    There is a window of WINDOW words at every start (one of all words in a shorter text). The states of its words come from runs that read up to
    WARM words beyond their own, so that a word is read a bounded number of times however many windows hold it. Null and
    empty texts have no window and the lowest logit; repeated rows and equal texts score alike; null doc_ids are scored and not held
    out; an empty table gives no rows; other columns are not read. One map stage without shuffle; the
    network travels once per executor and texts are read in numpy, without Python work per word, 2 MB of texts or one longer text at a time.
    """
    sent = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            got = net.scores(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(got), pa.array((got >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
