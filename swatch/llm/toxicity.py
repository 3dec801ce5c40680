"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

* Words are lower-cased runs of ASCII letters and anything beyond ASCII.  A word enters as: the
  lower bound of its log odds for toxic documents, the highest such bound of its character 4- and
  5-grams (with word borders), a hashed word vector and the mean of its hashed character vectors.
* Windows of ``SPAN`` words start every ``STEP`` words, the last ends with the text; a shorter text is
  one window.  Every window of every text is scored; a document's score is the highest.
* Labels belong to documents, so training alternates: the windows that score highest (at first by
  log odds) stand for their document, then the network is fitted to them by Adam.

The model is fitted on at most about ``MAX_POSITIVE`` toxic and ``MAX_NEGATIVE`` other labelled rows (hashes of the
ids below a share).  Null and wordless texts score 0 and have no window, as does every text if the
labels have one class only.  Repeated rows are scored each.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.llm.common import map_rows
from swatch.llm.languages import _FOLD

SPAN, STEP = 32, 16
MAX_POSITIVE, MAX_NEGATIVE = 1000, 4000
HIDDEN, VECTOR, SLOTS, POOL = 8, 6, 1 << 13, 8
MEMO_WORDS = 500_000
THRESHOLD = 0.3
BLOCK = 4096  # windows computed at once


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_FOLD).split()


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owners) of the character 4- and 5-grams of bordered words, in order of their words.

    A code holds the bytes of the gram and, above them, its length."""
    raw = b"".join([b"^" + w + b"$$$" for w in words])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 4
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the end of the word
    code, parts = np.zeros(len(data), np.uint64), []
    for n in range(5):
        code[:len(data) - n] |= data[n:] << np.uint64(8 * n)
        if n >= 3:
            keep = left > n
            parts.append((code[keep] | np.uint64((n + 1) << 56), owner[keep]))
    codes, owners = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owners, kind="stable")
    return codes[order], owners[order]


def starts_of(n: int) -> list[int]:
    """Word offsets of the windows of a text of ``n`` words."""
    if n <= SPAN:
        return [0] if n else []
    out = list(range(0, n - SPAN, STEP))
    return out + [n - SPAN]


def log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Lower bounds (2.5 standard errors) of the log odds of keys in 3 toxic texts at least, else 0."""
    low = (np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
           - 2.5 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))
    return np.where((pos > 2) & (low > 0), low, 0.0)


class Inputs:
    """Input rows of words."""

    def __init__(self, model: dict):
        self.words, (self.codes, self.bounds) = model["word_odds"], model["char_odds"]

    def rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(odds, word slot, character slots, owner of each) of distinct words."""
        codes, owner = char_grams(words)
        odds = np.zeros((len(words), 2), np.float32)
        odds[:, 0] = [self.words.get(w, 0.0) for w in words]
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            found = np.where(self.codes[at] == codes, self.bounds[at], 0.0)
            odds[:, 1] = np.maximum.reduceat(found, np.searchsorted(owner, np.arange(len(words))))
        slots = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64) % SLOTS
        return odds, np.array([zlib.crc32(w) % SLOTS for w in words], np.int64), slots, owner


def embed(params: dict, rows) -> np.ndarray:
    odds, word, chars, owner = rows
    n = len(odds)
    sums = np.zeros((n, VECTOR), np.float32)
    if n:
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sums = np.add.reduceat(params["chars"][chars], edge, axis=0) / np.diff(np.append(edge, len(owner)))[:, None]
    return np.concatenate([odds, params["words"][word], sums.astype(np.float32)], axis=1)


def init(seed: int = 7) -> dict:
    g = np.random.default_rng(seed)
    e, h = 2 + 2 * VECTOR, HIDDEN
    mat = lambda *s: (g.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    p = {"words": 0.05 * mat(SLOTS, VECTOR) * math.sqrt(SLOTS), "chars": 0.05 * mat(SLOTS, VECTOR) * math.sqrt(SLOTS)}
    for d in "fb":
        p[f"W{d}"], p[f"U{d}"], p[f"c{d}"] = mat(e, 3 * h), mat(h, 3 * h), np.zeros(3 * h, np.float32)
    p["A"], p["a"], p["v"] = mat(2 * h, POOL), np.zeros(POOL, np.float32), mat(POOL)
    p["o"], p["ob"] = mat(2 * h), np.zeros(1, np.float32)
    return p


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _direction(proj, U, mask, back: bool, tape: list | None):
    """Hidden states (time, window, HIDDEN) of one direction; ``proj(t)`` gives the projected inputs."""
    steps, n = mask.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((steps, n, HIDDEN), np.float32)
    full = mask.all()
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x, hu = proj(t), h @ U
        zr = 1.0 / (1.0 + np.exp(-np.clip(x[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN], -30, 30)))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
        new = h + z * (c - h)
        if not full:
            new = np.where(mask[t][:, None], new, h)
        if tape is not None:
            tape.append((t, h, z, r, c, hu[:, 2 * HIDDEN:]))
        out[t] = h = new
    return out


def forward(params: dict, proj_f, proj_b, mask, tape: dict | None = None) -> np.ndarray:
    """Logit per window; ``mask`` is (time, window)."""
    tf, tb = ([], []) if tape is not None else (None, None)
    hf = _direction(proj_f, params["Uf"], mask, False, tf)
    hb = _direction(proj_b, params["Ub"], mask, True, tb)
    hs = np.concatenate([hf, hb], axis=2)
    u = np.tanh(hs @ params["A"] + params["a"])
    s = np.where(mask, u @ params["v"], -1e9)
    w = np.exp(s - s.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tn,tnh->nh", w, hs)
    if tape is not None:
        tape.update(tf=tf, tb=tb, hs=hs, u=u, w=w, pooled=pooled)
    return pooled @ params["o"] + params["ob"][0]


def gradients(params: dict, x: np.ndarray, mask, tape: dict, dlogit: np.ndarray) -> dict:
    """Backward pass; ``x`` is (time, window, inputs)."""
    g = {}
    hs, u, w = tape["hs"], tape["u"], tape["w"]
    g["o"], g["ob"] = tape["pooled"].T @ dlogit, np.array([dlogit.sum()], np.float32)
    dpool = dlogit[:, None] * params["o"]
    dhs = w[:, :, None] * dpool
    dw = np.einsum("tnh,nh->tn", hs, dpool)
    ds = w * (dw - (w * dw).sum(0))
    g["v"] = np.einsum("tn,tnp->p", ds, u)
    du = ds[:, :, None] * params["v"] * (1 - u * u)
    g["A"], g["a"] = np.einsum("tnh,tnp->hp", hs, du), du.sum((0, 1))
    dhs += du @ params["A"].T
    dx = np.zeros_like(x)
    for d, own, taped in (("f", slice(0, HIDDEN), tape["tf"]), ("b", slice(HIDDEN, None), tape["tb"])):
        W, U = params[f"W{d}"], params[f"U{d}"]
        gW, gU, gc = np.zeros_like(W), np.zeros_like(U), np.zeros(3 * HIDDEN, np.float32)
        carry = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, h, z, r, c, hc in reversed(taped):
            total = dhs[t][:, own] + carry
            on = mask[t][:, None]
            new = np.where(on, total, 0)
            dz, dc = new * (c - h) * z * (1 - z), new * z * (1 - c * c)
            dr = dc * hc * r * (1 - r)
            pre = np.concatenate([dz, dr, dc], axis=1)
            hidden = np.concatenate([dz, dr, dc * r], axis=1)
            gW += x[t].T @ pre
            gc += pre.sum(0)
            gU += h.T @ hidden
            dx[t] += pre @ W.T
            carry = np.where(on, new * (1 - z), total) + hidden @ U.T
        g[f"W{d}"], g[f"U{d}"], g[f"c{d}"] = gW, gU, gc
    g["x"] = dx
    return g


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
        rounds: int = 4, epochs: int = 4, seed: int = 7) -> dict:
    """Model from labelled rows (text and a 0/1 label)."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), (F.col(label_col) > 0).alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = F.when(F.col("y"), F.lit(int(min(1.0, MAX_POSITIVE / max(1, sizes.get(True, 0))) * (1 << 30)))).otherwise(
        F.lit(int(min(1.0, MAX_NEGATIVE / max(1, sizes.get(False, 0))) * (1 << 30))))
    picked = rows.where(F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) < cut).toArrow()
    order = np.argsort(picked.column("id").to_pylist(), kind="stable")  # the result does not depend on the order of tasks
    column, labels = picked.column("text"), picked.column("y").to_pylist()
    vocabulary: dict[bytes, int] = {}
    ids, ys = [], []
    for i in order.tolist():
        words = words_of(column[i].as_py())
        if words:
            ids.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
            ys.append(labels[i])
    ys = np.array(ys, bool)
    model = {"word_odds": {}, "char_odds": (np.zeros(0, np.uint64), np.zeros(0, np.float32)), "params": None}
    if not ys.any() or ys.all():
        return model
    names = list(vocabulary)
    del picked, column, vocabulary
    n_pos, n_neg = int(ys.sum()), int((~ys).sum())
    codes, owner = (np.concatenate(x) for x in zip(*[
        (c, o.astype(np.int32) + at) for at in range(0, len(names), 50_000) for c, o in [char_grams(names[at:at + 50_000])]]))
    char_first = np.searchsorted(owner, np.arange(len(names) + 1))
    kinds, code_of = np.unique(codes, return_inverse=True)
    code_of = code_of.astype(np.int32)
    del codes, owner
    in_words, in_chars = np.zeros((2, len(names)), np.int32), np.zeros((2, len(kinds)), np.int32)
    for own, y in zip(ids, ys):  # each key once a text
        words = np.unique(own)
        in_words[int(y), words] += 1
        in_chars[int(y), np.unique(np.concatenate([code_of[char_first[w]:char_first[w + 1]] for w in words]))] += 1
    low = log_odds(in_words[1], in_words[0], n_pos, n_neg)
    model["word_odds"] = {names[i]: float(low[i]) for i in np.flatnonzero(low)}
    low = log_odds(in_chars[1], in_chars[0], n_pos, n_neg)
    model["char_odds"] = kinds[low > 0], low[low > 0].astype(np.float32)
    del code_of, kinds, in_chars, in_words

    g = np.random.default_rng(seed)
    params = init(seed)
    inputs = Inputs(model)
    parts = [inputs.rows(names[at:at + 50_000]) for at in range(0, len(names), 50_000)]
    feats = (np.concatenate([f[0] for f in parts]), np.concatenate([f[1] for f in parts]),
             np.concatenate([f[2].astype(np.int16) for f in parts]),
             np.repeat(np.arange(len(names), dtype=np.int32), np.diff(char_first)))
    del parts
    owner = np.array([i for i, d in enumerate(ids) for _ in starts_of(len(d))])
    starts = np.array([s for d in ids for s in starts_of(len(d))])
    flat = np.concatenate(ids)
    base = np.cumsum([0] + [len(d) for d in ids])
    lens = np.minimum(SPAN, np.array([len(d) for d in ids]))[owner]
    where = np.minimum(starts[:, None] + np.arange(SPAN), starts[:, None] + lens[:, None] - 1) + base[owner][:, None]
    windows, masks = flat[where], np.arange(SPAN)[None, :] < lens[:, None]
    del where, flat
    strength = np.where(masks, feats[0].sum(1)[windows], np.float32(0)).max(1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for turn in range(rounds):
        if turn:
            strength = _score_windows(params, table_of(params, feats), windows, masks)
        # The best window of each document, and of the others one more at random.
        best = np.lexsort((strength, owner))
        last = best[np.flatnonzero(np.append(owner[best][1:] != owner[best][:-1], True))]
        extra = g.choice(len(owner), size=min(len(owner), 2 * len(ids)), replace=False)
        chosen = np.unique(np.concatenate([last, extra[~ys[owner[extra]]]]))
        y = ys[owner[chosen]].astype(np.float32)
        weight = np.where(y > 0, min(10.0, (len(y) - y.sum()) / max(1.0, y.sum())) ** 0.5, 1.0).astype(np.float32)
        for _ in range(epochs):
            mixed = g.permutation(len(chosen))
            for at in range(0, len(mixed), 256):
                pick = mixed[at:at + 256]
                own, used = np.unique(windows[chosen[pick]], return_inverse=True)
                spans = [np.arange(char_first[w], char_first[w + 1]) for w in own]
                sub = (feats[0][own], feats[1][own], feats[2][np.concatenate(spans)],
                       np.repeat(np.arange(len(own)), [len(s) for s in spans]))
                table = embed(params, sub)
                used = used.reshape(len(pick), SPAN).T
                mask = masks[chosen[pick]].T
                x = table[used]
                tape: dict = {}
                logit = forward(params, lambda t: x[t] @ params["Wf"] + params["cf"],
                                lambda t: x[t] @ params["Wb"] + params["cb"], mask, tape)
                dlogit = ((_sigmoid(logit) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grad = gradients(params, x, mask, tape, dlogit)
                dx = np.zeros((len(own), x.shape[2]), np.float32)
                np.add.at(dx, used.ravel(), grad.pop("x").reshape(-1, x.shape[2]))
                for name, slots, part in (("words", sub[1], dx[:, 2:2 + VECTOR]),
                                          ("chars", sub[2], (dx[:, 2 + VECTOR:] / np.bincount(sub[3])[:, None])[sub[3]])):
                    grad[name] = np.zeros_like(params[name])
                    np.add.at(grad[name], slots, part)
                step += 1
                for k, v in params.items():
                    m, s = moments[k]
                    m += 0.1 * (grad[k] - m)
                    s += 0.001 * (grad[k] ** 2 - s)
                    v -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-7)
    model["params"] = params
    return model


def table_of(params: dict, feats) -> np.ndarray:
    """Input rows of all words of ``Inputs.rows``, some at a time."""
    first = np.searchsorted(feats[3], np.arange(len(feats[0]) + 1))
    out = []
    for at in range(0, len(feats[0]), 50_000):
        to = min(len(feats[0]), at + 50_000)
        a, b = first[at], first[to]
        out.append(embed(params, (feats[0][at:to], feats[1][at:to], feats[2][a:b], feats[3][a:b] - at)))
    return np.concatenate(out)


def _score_windows(params: dict, table: np.ndarray, windows: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Probability per window; ``windows`` holds rows of ``table``."""
    pf, pb = table @ params["Wf"] + params["cf"], table @ params["Wb"] + params["cb"]
    out = np.zeros(len(windows))
    for at in range(0, len(windows), BLOCK):
        own, mask = windows[at:at + BLOCK].T, masks[at:at + BLOCK].T
        out[at:at + BLOCK] = _sigmoid(forward(params, lambda t: pf[own[t]], lambda t: pb[own[t]], mask))
    return out


class Scorer:
    """Scores texts; words keep their projected inputs, a bounded number of them at a time."""

    def __init__(self, model: dict):
        self.model, self.params, self.inputs = model, model["params"], Inputs(model)
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """Row of each word in the table of projected inputs, after adding what is new."""
        get = self.index.get
        rows = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return rows
        new = list(dict.fromkeys([words[i] for i in missing]))
        if len(self.index) + len(new) > len(self.table):
            if self.index:  # begin anew, with what this step needs
                self.index = {}
                self.table = self.table[:0]
                return self._rows(words)
            self.table = np.empty((max(MEMO_WORDS, len(new)), 6 * HIDDEN), np.float32)
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            x = embed(self.params, self.inputs.rows(part))
            to = len(self.index)
            self.table[to:to + len(part), :3 * HIDDEN] = x @ self.params["Wf"] + self.params["cf"]
            self.table[to:to + len(part), 3 * HIDDEN:] = x @ self.params["Wb"] + self.params["cb"]
            self.index.update(zip(part, range(to, to + len(part))))
        rows[missing] = [self.index[words[i]] for i in missing]
        return rows

    def score(self, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """Per text, all windows as (first word, end word, score)."""
        docs = [words_of(t) for t in texts]
        if self.params is None:
            return [[] for _ in docs]
        words = [w for d in docs for w in d]
        rows = self._rows(words)
        table = self.table
        base = np.cumsum([0] + [len(d) for d in docs])
        starts = [starts_of(len(d)) for d in docs]
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        first = np.array([s for own in starts for s in own], np.int64)
        lens = np.minimum(SPAN, np.diff(base))[owner]
        out = np.zeros(len(first))
        half = 3 * HIDDEN
        # Whole windows need no mask; only texts shorter than a window have another length.
        for short in (False, True):
            group = np.flatnonzero((lens < SPAN) == short)
            for at in range(0, len(group), BLOCK):
                own = group[at:at + BLOCK]
                inside = np.arange(SPAN)[:, None] < lens[own]
                where = base[owner[own]] + first[own] + np.minimum(np.arange(SPAN)[:, None], lens[own] - 1)
                used = rows[where]
                out[own] = _sigmoid(forward(self.params, lambda t: table[used[t], :half],
                                            lambda t: table[used[t], half:], inside))
        cut = np.cumsum([0] + [len(s) for s in starts])
        return [[(int(s), int(s + n), float(p)) for s, n, p in zip(first[a:b], lens[a:b], out[a:b])]
                for a, b in zip(cut, cut[1:])]


_SCORERS: dict[str, Scorer] = {}


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``id_col``, ``score`` (highest window, 0 to 1), ``windows`` (number), ``spans`` (windows at
    or above ``threshold``: first word, end word, score).  One pass in place, no shuffle."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    slim = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    schema = T.StructType([slim.schema[id_col], *T.StructType.fromDDL(
        "score double, windows long, spans array<struct<first:int,end:int,score:double>>").fields])

    def run(ids, texts):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        scorer, got, at = _SCORERS[key], [], 0
        while at < len(texts):  # steps of about 4 MB of text, or one text
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= 4 << 20):
                size += len(texts[to] or "")
                to += 1
            got += scorer.score(texts[at:to])
            at = to
        return [ids, [max((p for *_, p in w), default=0.0) for w in got], [len(w) for w in got],
                [[{"first": a, "end": b, "score": p} for a, b, p in w if p >= threshold] for w in got]]

    return map_rows(slim, run, schema, rows_per_step=1024)
