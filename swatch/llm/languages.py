"""Language identification: script ranges, per-word scores and a Viterbi path with a switching penalty.

* A word is a run of letters (ASCII letters and anything beyond ASCII), lower-cased.  The script of
  its letters leaves only the languages seen with that script as candidates.
* Each candidate scores a word with a smoothed character trigram model learned from labelled texts.
* The best path over the words pays ``penalty`` for each change of language; equal labels in a row
  are a span.  The label with most letters is the text's language (of equals, the first in order).

Null texts and texts without a letter get ``und`` and score 0 and have no spans.  The model is fitted on a
sample of at most about ``sample_rows`` labelled rows of each language (a hash of the id below its share): trigrams and
scripts are counted by Spark; the table is as large as the sample's trigrams, whatever the corpus.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.llm.common import drop_held, map_rows

SAMPLE_ROWS = 8000  # of a language
PENALTY = 18.0
FLOOR = -12.0  # a word speaks against a language by this much at most
ALPHA = 0.5
MEMO_ENTRIES = 400_000

# First code points of script ranges, in order of code points.
SCRIPTS = [(0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
           (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"),
           (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"),
           (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
           (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other")]
_STARTS = [s for s, _ in SCRIPTS]
# Letters and bytes beyond ASCII stay (A-Z in lower case); the rest separates words.
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def script_of(word: str) -> str:
    found = Counter(SCRIPTS[max(0, bisect_right(_STARTS, ord(c)) - 1)][1] for c in word if c.isalpha())
    return max(sorted(found), key=found.get) if found else ""


def _trigrams(word: str) -> list[str]:
    word = f"^{word}$"
    return [word[i:i + 3] for i in range(len(word) - 2)]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS) -> dict:
    """Trigram and script counts per language over a sample of ``labelled`` rows."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    lang = F.col(lang_col).cast("string")
    cuts = [(r["lang"], int(min(1.0, sample_rows / r["count"]) * (1 << 30)))
            for r in rows.groupBy(lang.alias("lang")).count().collect()]
    cut = F.create_map(*[F.lit(x) for pair in cuts for x in pair])[lang] if cuts else F.lit(0)
    picked = rows.where(F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col).cast("string")), F.lit(1 << 30)) < cut)
    slim = picked.select(lang.alias("lang"), F.col(text_col).alias("text"))

    def count(langs, texts):
        drop_held()
        # A word is taken apart once for all rows of the step that hold it.
        words: dict[str, Counter] = {}
        for lang, text in zip(langs, texts):
            words.setdefault(lang, Counter()).update(text.encode("utf-8").translate(_FOLD).split())
        got: Counter = Counter()
        for lang, own in words.items():
            for w, n in own.items():
                word = w.decode("utf-8", "ignore").lower()
                script = script_of(word)
                if script:
                    got[lang, "", script] += n
                    for t in _trigrams(word):
                        got[lang, "t", t] += n
        keys = list(got)
        return [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [got[k] for k in keys]]

    part = map_rows(slim, count, T.StructType.fromDDL("lang string, kind string, feature string, n long"))
    table = part.groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(table["lang"]))
    scripts: dict[str, list[str]] = {}
    grams: dict[str, list[int]] = {}
    total, seen = [0] * len(langs), [0] * len(langs)
    for lang, kind, feature, n in zip(*(table[k] for k in ("lang", "kind", "feature", "n"))):
        at = langs.index(lang)
        if kind:
            grams.setdefault(feature, [0] * len(langs))[at] = n
            total[at] += n
        else:
            scripts.setdefault(feature, [0] * len(langs))[at] = n
            seen[at] += n
    size = len(grams) + 1
    weights = {g: tuple(math.log((n + ALPHA) / (t + ALPHA * size)) for n, t in zip(ns, total))
               for g, ns in grams.items()}
    unknown = tuple(math.log(ALPHA / (t + ALPHA * size)) for t in total)
    allowed = {s: [n > 1e-3 * t for n, t in zip(ns, seen)] for s, ns in scripts.items()}
    return {"langs": langs, "weights": weights, "unknown": unknown, "scripts": allowed}


class _Scorer(dict):
    """Word -> packed float32: a score per language (0 the best, FLOOR the least), then its letters."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        got = self.old.get(word) or self.score(word)
        self[word] = got
        return got

    def score(self, raw: bytes) -> bytes:
        model = self.model
        word = raw.decode("utf-8", "ignore").lower()
        letters = len(word) if word.isalpha() else sum(map(str.isalpha, word))
        k = len(model["langs"])
        if not letters:
            return np.zeros(k + 1, np.float32).tobytes()
        get, unknown = model["weights"].get, model["unknown"]
        sums = [sum(x) for x in zip(*[get(t, unknown) for t in _trigrams(word)])]
        may = model["scripts"].get(script_of(word)) or [True] * k
        if not any(may):
            may = [True] * k
        top = max(s for s, ok in zip(sums, may) if ok)
        return np.array([max(FLOOR, s - top) if ok else FLOOR for s, ok in zip(sums, may)] + [letters],
                        np.float32).tobytes()


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Label per row of the path with the highest sum of scores less ``penalty`` per change.

    Leaving the best single label pays only if some stretch gains half a penalty elsewhere (m
    stretches cost m - 1 changes at least); else that label is the whole path.  Of equals, the lowest.
    """
    n, k = scores.shape
    best = int(np.argmax(scores.sum(0)))
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, best:best + 1], axis=0, dtype=np.float64, out=gain[1:])
    if k == 1 or (gain - np.minimum.accumulate(gain, axis=0)).max() < penalty / 2:
        return np.full(n, best, np.int32)
    now, back = [0.0] * k, []
    for row in scores.tolist():
        top = max(now)
        at, line = now.index(top), []
        for j in range(k):
            if now[j] >= top - penalty:
                line.append(j)
                now[j] += row[j]
            else:
                line.append(at)
                now[j] = top - penalty + row[j]
        back.append(line)
    path, at = np.zeros(n, np.int32), now.index(max(now))
    for t in range(n - 1, -1, -1):
        path[t] = at
        at = back[t][at]
    return path


def label(text: str | None, scorer: _Scorer, penalty: float):
    """(language, score, spans) of one text."""
    langs = scorer.model["langs"]
    folded = (text or "").encode("utf-8").translate(_FOLD)
    words = folded.split()
    k = len(langs)
    if not words or not k:
        return "und", 0.0, []
    table = np.frombuffer(b"".join(map(scorer.__getitem__, words)), np.float32).reshape(-1, k + 1)
    letters = table[:, k]
    if not letters.any():
        return "und", 0.0, []
    path = viterbi(table[:, :k], penalty)
    mass = np.bincount(path, weights=letters, minlength=k)
    best = int(np.argmax(mass))
    own = table[path == best, :k].sum(0, dtype=np.float64)
    sure = 1.0 / np.exp(np.clip(own - own[best], -60, 60)).sum()
    cuts = np.flatnonzero(np.diff(path)) + 1
    if len(cuts):
        mask = np.zeros(len(folded) + 2, np.int8)
        mask[1:-1] = np.frombuffer(folded, np.uint8) != 32
        turn = np.diff(mask)
        begins, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        edge = [0, *cuts.tolist(), len(words)]
        spans = [{"begin": int(begins[a]), "end": int(ends[b - 1]), "lang": langs[path[a]]}
                 for a, b in zip(edge, edge[1:])]
    else:
        spans = [{"begin": len(folded) - len(folded.lstrip(b" ")), "end": len(folded.rstrip(b" ")),
                  "lang": langs[best]}]
    return langs[best], float(min(1.0, sure) * mass[best] / mass.sum()), spans


_SCORERS: dict[str, _Scorer] = {}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = PENALTY, keep: list[str] | None = None) -> DataFrame:
    """Per row: ``id_col`` (or the ``keep`` columns), ``lang_pred``, ``score`` (0 to 1: share of the
    letters in spans of that language times its posterior there) and ``spans`` (byte spans with a
    language).  One pass in place, no shuffle."""
    keep = keep or [id_col]
    slim = docs.select(*[docs[c].alias(c) for c in keep], docs[text_col].alias("__text"))
    out = "lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>"
    schema = T.StructType([*[slim.schema[c] for c in keep], *T.StructType.fromDDL(out).fields])
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(*cols):
        if key not in _SCORERS:
            drop_held()
            _SCORERS.clear()
            _SCORERS[key] = _Scorer(shared.value)
        got = [label(t, _SCORERS[key], penalty) for t in cols[-1]]
        lang, score, spans = zip(*got) if got else ((), (), ())
        return [*cols[:-1], lang, pa.array(score, pa.float64()), spans]

    return map_rows(slim, run, schema)
