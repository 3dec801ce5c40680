"""Scoring documents by prediction by partial matching over bytes, beside a token unigram base.

A text is lower-cased (A-Z), cut into words at ASCII white space, and read as the bytes of every word
followed by a space, then a line feed as the end.  The pretrained trie holds, for contexts of 0 to
``ORDER`` bytes, all symbols that followed them in the training texts.  Escape estimation (method D): with n
occurrences of a context, a symbol of count c has (c - 1/2) / n, escaping the rest; after an
escape the symbols of the longer context are excluded from the counts of the shorter one.  Below order 0 the bytes left are equally likely.

Nothing is pruned at any size.  Counts are taken over all training texts: each task adds up its own
(ORDER + 1)-grams, Spark sums them, and shorter contexts are sums of longer ones.  The cost of a symbol depends on its
(ORDER + 1)-gram only.  Grams whose count reaches ``SHARE`` of all training symbols (at most 1 / SHARE) are
broadcast with their costs; each document's other distinct grams are joined to the costs that ``gram_costs`` takes from
the tables of all contexts.  A corpus of at most 1 / SHARE symbols is broadcast whole.

The base needs the count of every token.  Tokens that reach ``TOKEN_SHARE`` of all (at most 1 / TOKEN_SHARE) are
broadcast; the rest is joined by token, where by definition no key is hot.

Null text is empty (an end alone).  Rows that repeat are each scored.  Without training rows every
symbol has 1/256 and the base is 0.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.llm.common import list_array, map_rows
from swatch.session import materialize

ORDER = 5
SHARE = 2.0 ** -21
TOKEN_SHARE = 2.0 ** -20
DISCOUNT = 0.5
END = b"\n"
BROADCAST_COSTS = 1_000_000
FLUSH_GRAMS, FLUSH_TOKENS = 3_000_000, 300_000  # a task hands on its counts beyond so many keys
PAD = END * ORDER  # what stands before a text
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_FOLD).split()


def symbols_of(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" " + END if words else END


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER + 1)-gram ending at each symbol of each text, symbol in the lowest byte; ends of the texts."""
    raw = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    code = raw.astype(np.uint64)
    total = code.copy()
    for k in range(1, ORDER + 1):
        total[k:] |= code[:-k] << np.uint64(8 * k)
    keep = np.ones(len(raw), bool)
    starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    keep[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return total[keep], np.cumsum(sizes)


def _add_up(keys: np.ndarray, counts: np.ndarray | None = None):
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_corpus(train: DataFrame, text_col: str = "text") -> DataFrame:
    """All counts of the training texts: ``gram`` (or null), ``token`` (or null; the end is a line
    feed), ``n``.  A task sums its own first; the sum over tasks is written once."""
    schema = pa.schema([("gram", pa.int64()), ("token", pa.binary()), ("n", pa.int64())])

    def emit(keys, counts):
        for at in range(0, len(keys), 500_000):
            part = keys[at:at + 500_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.binary()),
                                              pa.array(counts[at:at + 500_000].astype(np.int64))], schema=schema)

    def emit_tokens(tokens):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(tokens), pa.int64()), pa.array(list(tokens), pa.binary()),
                                          pa.array(list(tokens.values()), pa.int64())], schema=schema)

    def run(batches):
        tokens, keys, counts = Counter(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 1024):
                texts = []
                for text in column.slice(at, 1024).to_pylist():
                    words = words_of(text)
                    tokens.update(words)
                    tokens[END] += 1
                    texts.append(symbols_of(words))
                if len(tokens) >= FLUSH_TOKENS:
                    yield from emit_tokens(tokens)
                    tokens = Counter()
                new, n = _add_up(grams(texts)[0])
                keys, counts = _add_up(np.concatenate((keys, new)), np.concatenate((counts, n)))
                if len(keys) >= FLUSH_GRAMS:
                    yield from emit(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from emit(keys, counts)
        yield from emit_tokens(tokens)

    part = train.select(F.col(text_col).alias("text")).mapInArrow(run, "gram long, token binary, n long")
    return materialize(part.groupBy("gram", "token").agg(F.sum("n").alias("n")), "ppm-counts")


class Hashed:
    """Open-addressed table from uint64 keys to rows, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.slot_key = np.zeros(1 << self.bits, np.uint64)  # key + 1; 0 is free
        self.slot_row = np.zeros(1 << self.bits, np.int32)
        rest, at, self.probes = np.arange(len(keys)), self._home(keys), 1
        while len(rest):
            want = at[rest]
            free = self.slot_key[want] == 0
            _, first = np.unique(want, return_index=True)
            won = np.zeros(len(rest), bool)
            won[first] = True
            won &= free
            self.slot_key[want[won]] = keys[rest[won]] + np.uint64(1)
            self.slot_row[want[won]] = rest[won]
            rest = rest[~won]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(rest))

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at, want = self._home(keys), keys + np.uint64(1)
        out = np.full(len(keys), -1, np.int32)
        here = self.slot_key[at]
        hit = here == want
        out[hit] = self.slot_row[at[hit]]
        rest = np.flatnonzero(~hit & (here != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            here = self.slot_key[at[rest]]
            hit = here == want[rest]
            out[rest[hit]] = self.slot_row[at[rest[hit]]]
            rest = rest[~hit & (here != 0)]
        return out


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << (8 * symbols)) - 1)


class Trie:
    """Costs of a whole trie (of a pruned one, what is pruned adds to the escape).  ``levels[k]``: contexts of k bytes with ``ctx`` (codes, sorted), ``n``
    (occurrences), and the kept ``gram`` (context and symbol, sorted) with ``c``."""

    def __init__(self, levels: list[dict]):
        self.levels = []
        above: dict | None = None  # the level one byte shorter
        for k, raw in enumerate(levels):
            ctx, n, gram, c = (raw[x] for x in ("ctx", "n", "gram", "c"))
            node = np.searchsorted(ctx, gram >> np.uint64(8))
            d = np.bincount(node, minlength=len(ctx)).astype(float)
            kept = np.bincount(node, weights=c, minlength=len(ctx))
            with np.errstate(divide="ignore"):
                level = {"esc_top": np.log10((DISCOUNT * d + n - kept) / n), "den_top": np.log10(n),
                         "log_c": np.log10(c - DISCOUNT), "d": d, "kept": kept, "n": n, "ctx": ctx, "gram": gram, "c": c}
            level["top"] = level["log_c"] - level["den_top"][node]
            if above is not None:
                up = np.searchsorted(above["ctx"], ctx & _mask(k - 1))
                same = np.searchsorted(above["gram"], gram & _mask(k))
                gone = np.bincount(node, weights=above["c"][same], minlength=len(ctx))
                rest_n, rest_d = above["n"][up] - gone, above["d"][up] - d
                rest_kept = above["kept"][up] - gone
                with np.errstate(divide="ignore", invalid="ignore"):
                    level["den_up"] = np.where(rest_n > 0, np.log10(rest_n), 0.0)
                    level["esc_up"] = np.where(
                        rest_n > 0, np.log10((DISCOUNT * rest_d + rest_n - rest_kept) / rest_n), 0.0)
            level["nodes"], level["entries"] = Hashed(ctx), Hashed(gram)
            self.levels.append(level)
            above = level
        base = len(self.levels[0]["gram"]) if self.levels else 0
        self.uniform = -np.log10(max(1, 256 - base))

    def cost(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each (ORDER + 1)-gram."""
        out = np.zeros(len(code))
        rest = np.arange(len(code))
        below = np.full(len(code), -1, np.int32)  # node of the longer context that was escaped from
        for k in range(ORDER, -1, -1):
            level = self.levels[k] if k < len(self.levels) else None
            if level is None or not len(level["gram"]):
                continue
            own = code[rest] & _mask(k + 1)
            row = level["entries"].find(own)
            hit = row >= 0
            at, child = rest[hit], below[hit]
            fresh = child < 0
            value = level["top"][row[hit]]
            if not fresh.all():
                old = ~fresh
                value[old] = level["log_c"][row[hit][old]] - self.levels[k + 1]["den_up"][child[old]]
            out[at] += value
            rest, below, own = rest[~hit], below[~hit], own[~hit]
            if not len(rest):
                return out
            node = level["nodes"].find(own >> np.uint64(8))
            known, fresh = node >= 0, below < 0
            one = known & fresh
            out[rest[one]] += level["esc_top"][node[one]]
            two = ~fresh
            if two.any():
                out[rest[two]] += self.levels[k + 1]["esc_up"][below[two]]
            below = node
        out[rest] += self.uniform
        return out


class Frequent:
    """Costs of the (ORDER + 1)-grams of one level, NaN for others."""

    def __init__(self, level: dict):
        self.entries = Hashed(level["gram"])
        n = level["n"][np.searchsorted(level["ctx"], level["gram"] >> np.uint64(8))]
        self.costs = np.append(np.log10(level["c"] - DISCOUNT) - np.log10(n), np.nan)

    def cost(self, code: np.ndarray) -> np.ndarray:
        return self.costs[self.entries.find(code)]


def fit(counts: DataFrame, share: float = SHARE, token_share: float = TOKEN_SHARE) -> dict:
    """Bounded model tables from ``count_corpus``: trie levels, frequent tokens, N and V.

    ``whole``: the levels hold every gram; else only the last one is filled, with the frequent grams."""
    totals = counts.agg(
        F.sum(F.when(F.col("gram").isNotNull(), F.col("n"))).alias("symbols"),
        F.sum(F.when(F.col("token").isNotNull(), F.col("n"))).alias("N"),
        F.count("token").alias("V")).first()
    symbols, n_tokens = totals["symbols"] or 0, totals["N"] or 0
    least = max(1.0, share * symbols)
    level = counts.where("gram IS NOT NULL").select("gram", "n")
    both = None
    for k in range(ORDER, -1 if least <= 1 else ORDER - 1, -1):
        if k < ORDER:
            level = (level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("gram"))
                     .agg(F.sum("n").alias("n")))
        nodes = (level.groupBy(F.shiftright("gram", 8).alias("ctx"))
                 .agg(F.sum("n").alias("n"),
                      F.collect_list(F.when(F.col("n") >= least, F.struct("gram", "n"))).alias("kept"))
                 .where(F.size("kept") > 0).select(F.lit(k).alias("k"), "ctx", "n", "kept"))
        both = nodes if both is None else both.unionByName(nodes)
    # At most 1 / share entries per order: a proven bound on what the driver receives.
    entries = both.select("k", "ctx", "n", F.explode("kept").alias("e")).select("k", "ctx", "n", "e.gram", F.col("e.n").alias("c")).toArrow()
    k, ctx, n, gram, c = (entries.column(x).to_numpy() for x in ("k", "ctx", "n", "gram", "c"))
    levels = []
    for j in range(ORDER + 1):
        own = k == j
        code, first = np.unique(ctx[own].astype(np.uint64), return_index=True)
        order = np.argsort(gram[own].astype(np.uint64))
        levels.append({"ctx": code, "n": n[own][first].astype(float), "gram": gram[own].astype(np.uint64)[order],
                       "c": c[own][order].astype(float)})
    often = counts.where(F.col("token").isNotNull() & (F.col("n") >= max(1.0, token_share * n_tokens))).select("token", "n")
    often = often.toArrow()
    return {"levels": levels, "N": int(n_tokens), "V": int(totals["V"] or 0), "symbols": int(symbols), "whole": least <= 1,
            "often": dict(zip(often.column("token").to_pylist(), often.column("n").to_pylist()))}


def context_tables(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order 0 to ``ORDER``: all entries ``(gram, c)``, and all contexts ``(ctx, n, first, down, den)``.

    ``first``: log10 of escaping from the context as the longest known one; ``den``: log10 of what is left of the next shorter
    context's count without this one's symbols; ``down``: log10 of escaping from all shorter contexts in turn."""
    entries = [counts.where("gram IS NOT NULL").select("gram", F.col("n").alias("c"))]
    for k in range(ORDER - 1, -1, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("gram")
        level = entries[0].groupBy(short).agg(F.sum("c").alias("c"))
        entries.insert(0, materialize(level, "ppm-entries"))
    nodes: list[DataFrame] = []
    ctx, first = F.shiftright("gram", 8).alias("ctx"), F.log10(F.lit(DISCOUNT) * F.col("d") / F.col("n")).alias("first")
    for k, own in enumerate(entries):
        if k == 0:
            node = own.groupBy(ctx).agg(F.sum("c").alias("n"), F.count("c").alias("d")).select(
                "ctx", "n", "d", first, F.lit(0.0).alias("down"), F.lit(0.0).alias("den"))
        else:
            up = entries[k - 1].select(F.col("gram").alias("up"), F.col("c").alias("up_c"))
            above = nodes[k - 1].select(F.col("ctx").alias("up"), F.col("n").alias("up_n"), F.col("d").alias("up_d"),
                                        F.col("down").alias("up_down"))
            low = (1 << (8 * k)) - 1
            node = (own.withColumn("up", F.col("gram").bitwiseAND(F.lit(low))).join(up, "up").groupBy(ctx)
                    .agg(F.sum("c").alias("n"), F.count("c").alias("d"), F.sum("up_c").alias("gone"))
                    .withColumn("up", F.col("ctx").bitwiseAND(F.lit(low >> 8)))
                    .join(F.broadcast(above) if k <= 3 else above, "up"))  # at most 256 ^ 2 contexts
            rest, kinds = F.col("up_n") - F.col("gone"), F.col("up_d") - F.col("d")
            esc = F.when(rest > 0, F.log10(F.lit(DISCOUNT) * kinds / rest)).otherwise(0.0)
            node = node.select("ctx", "n", "d", first, (F.col("up_down") + esc).alias("down"),
                               F.when(rest > 0, F.log10(rest)).otherwise(0.0).alias("den"))
        nodes.append(materialize(node, "ppm-contexts"))
    return entries, nodes


def gram_costs(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``(gram, cost)`` of distinct (ORDER + 1)-grams: the log10 probability of the last symbol, from all counts."""
    entries, nodes = context_tables(counts)
    met = materialize(grams.join(entries[ORDER], "gram", "left"), "ppm-met")
    own = nodes[ORDER].select("ctx", "n")
    seen = (met.where("c IS NOT NULL").withColumn("ctx", F.shiftright("gram", 8)).join(own, "ctx")
            .select("gram", (F.log10(F.col("c") - F.lit(DISCOUNT)) - F.log10("n")).alias("cost")))
    # Grams never seen: the longest known context is escaped from, then the shorter ones in turn.
    state, none = met.where("c IS NULL").select("gram"), F.lit(None).cast("double")
    for col in ("cost", "esc", "down", "den"):  # of the context escaped from last
        state = state.withColumn(col, none)
    for k in range(ORDER, -1, -1):
        node = nodes[k].select("ctx", F.col("n").alias("_n"), F.col("first").alias("_first"),
                               F.col("down").alias("_down"), F.col("den").alias("_den"))
        state = state.withColumn("ctx", F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)), 8))
        state = state.join(F.broadcast(node) if k <= 2 else node, "ctx", "left")  # at most 256 ^ 2 contexts
        if k < ORDER:
            entry = entries[k].select(F.col("gram").alias("_gram"), "c")
            code = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
            state = state.join(F.broadcast(entry) if k <= 1 else entry, code == F.col("_gram"), "left")
            log_c = F.log10(F.col("c") - F.lit(DISCOUNT))
            hit = (F.when(F.col("c").isNotNull() & F.col("esc").isNull(), log_c - F.log10("_n"))
                   .when(F.col("c").isNotNull(), F.col("esc") - F.col("down") + log_c - F.col("den")))
            state = state.withColumn("cost", F.coalesce("cost", hit))
        state = state.select("gram", "cost", F.coalesce("esc", F.col("_first") + F.col("_down")).alias("esc"),
                             F.coalesce("_down", "down").alias("down"), F.coalesce("_den", "den").alias("den"))
        if k in (ORDER - 1, ORDER - 2):  # most are met here; the rest goes on
            state = materialize(state, "ppm-unseen")
            seen, state = seen.unionByName(state.where("cost IS NOT NULL").select("gram", "cost")), state.where("cost IS NULL")
    left = F.lit(-float(np.log10(max(1, 256 - entries[0].count()))))
    return materialize(seen.unionByName(state.select("gram", F.coalesce("cost", F.col("esc") + left).alias("cost"))), "ppm-costs")


_TRIES: dict[str, tuple] = {}


def score_documents(docs: DataFrame, counts: DataFrame, model: dict, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10
    probability of the text under the trie).

    One pass over the texts; of it only tokens and grams that are not frequent travel, one row per document and
    token or gram, to meet their counts and costs."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias(id_col), docs[text_col].alias("text"))
    schema = T.StructType([*slim.drop("text").schema.fields, *T.StructType.fromDDL(
        "n_tokens long, known long, base double, score double, rare array<struct<token:binary,times:int>>, grams array<long>, gram_times array<int>").fields])
    total = model["N"] + 0.1 * (model["V"] + 1)

    def run(rows, ids, texts):
        if key not in _TRIES:
            _TRIES.clear()
            m = shared.value
            logs = {t: np.log10((c + 0.1) / total) for t, c in m["often"].items()}
            logs.setdefault(END, np.log10(0.1 / total))
            _TRIES[key] = (Trie(m["levels"]) if m["whole"] else Frequent(m["levels"][ORDER]), logs, END in m["often"])
        trie, logs, end_known = _TRIES[key]
        n_tokens, known, base, rare, streams = [], [], [], [], []
        for text in texts:
            words = words_of(text)
            streams.append(symbols_of(words))
            tally = Counter(words)
            sum_, hits, others = logs[END], int(end_known), []
            for token, times in tally.items():
                got = logs.get(token)
                if got is None:
                    others.append({"token": token, "times": times})
                else:
                    sum_ += times * got
                    hits += times
            n_tokens.append(len(words) + 1), known.append(hits), base.append(float(sum_)), rare.append(others)
        score, away, away_times, away_sizes = [], [], [], []
        at = 0
        while at < len(streams):  # steps of a few MB of symbols, or one text
            to, size = at, 0
            while to < len(streams) and (to == at or size + len(streams[to]) <= 1 << 21):
                size += len(streams[to])
                to += 1
            code, ends = grams(streams[at:to])
            cost = trie.cost(code)
            unmet = np.isnan(cost)  # to be joined
            sums = np.concatenate(([0.0], np.cumsum(np.where(unmet, 0.0, cost))))[ends]
            score += np.diff(np.concatenate(([0.0], sums))).tolist()
            for begin, end in zip(np.concatenate(([0], ends)), ends):
                own, times = np.unique(code[begin:end][unmet[begin:end]], return_counts=True)
                away.append(own.astype(np.int64)), away_times.append(times), away_sizes.append(len(own))
            at = to
        grams_, times_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (away, away_times))
        return [rows, ids, n_tokens, known, base, score, rare, list_array(grams_, away_sizes, pa.int64()),
                list_array(times_.astype(np.int32), away_sizes, pa.int32())]

    scored = base_rows = materialize(map_rows(slim, run, schema), "ppm-scored")
    tokens = counts.where("token IS NOT NULL").select("token", F.col("n").alias("c"))
    met = (scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times")
           .join(tokens, "token", "left").groupBy("row")
           .agg(F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(total))).alias("more"),
                F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("also")))
    scored, score = scored.join(met, "row", "left"), F.col("score")
    if not model["whole"]:
        unmet = base_rows.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("g")).select(
            "row", F.col("g.grams").alias("gram"), F.col("g.gram_times").alias("times"))
        costs = gram_costs(unmet.select("gram").distinct(), counts)
        few = costs.limit(BROADCAST_COSTS + 1).count() <= BROADCAST_COSTS
        # Grams that many training texts hold are frequent and broadcast; one side has each gram once.
        rest = (unmet.join(F.broadcast(costs) if few else costs, "gram").groupBy("row")
                .agg(F.sum(F.col("times") * F.col("cost")).alias("rest")))
        scored, score = scored.join(rest, "row", "left"), score + F.coalesce("rest", F.lit(0.0))
    return scored.select(
        id_col, "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(model["N"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"))
