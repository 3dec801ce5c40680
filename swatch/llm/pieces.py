"""SentencePiece encoding and decoding with byte spans of the original text.

``PieceModel`` reads a compiled model file (BPE kind) and works as follows.

* Normalisation: at each position the longest prefix found in the compiled character map (a double
  array trie over UTF-8 bytes) is replaced; anything else passes one character.  Each normalised
  character remembers the byte span of the original it came from.
* Segmentation: the best scored adjacent pair merges first, the leftmost of equals.  Two neighbouring
  characters that stand side by side in no piece can never merge, so the text falls into units that
  are encoded once and remembered (a bounded memory per task).
* Every piece is projected back through the alignment to a byte span ``[begin, end)``.

Null text counts as empty; an empty text gives the end id alone and decodes to ``""``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from swatch.llm.common import held, list_array, map_rows

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MEMO_ENTRIES = 200_000  # words, and units within words, remembered per process and generation
RUNS = re.compile(r"[^\W_]+|[\W_]+")  # where a unit may fall apart, unless a piece crosses there
NEVER = 1 << 40  # cost of a pair that is no piece


class CharMap:
    """Longest-prefix replacement through the compiled character map; empty bytes mean identity."""

    def __init__(self, blob: bytes):
        self.units, self.strings = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of ``data[at:]``."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)  # noqa: E731 - child offset of a trie unit
        node = step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit & 0x100:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[start:self.strings.index(b"\0", start)])
        return found


class _Memo(dict):
    """Unit -> packed ids, filled on demand.  Full, it becomes the old generation, from which units
    still in use come back without being encoded again."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, unit):
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        got = self.old.get(unit)
        if got is None:
            got = self.encode(unit)
        self[unit] = got
        return got


class PieceModel:
    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models of normal, byte, control and unknown pieces are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only models that mark spaces before a word are supported")
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.names = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        order = {s: r for r, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.rank = {p: order[proto.pieces[i].score] for p, i in self.ids.items()}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.end = self.names.index(proto.trainer_spec.eos_piece or "</s>")
        bytes_ = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.is_byte = {i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        # What a piece reads as: a control piece as nothing, a byte piece as its byte.
        unk = (proto.trainer_spec.unk_surface or " ⁇ ").encode()
        self.surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" if p.type == CONTROL
                        else unk if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode()
                        for p in proto.pieces]
        self.width = np.array([len(s) for s in self.surface], np.int64)
        self.pairs = {name[i:i + 2] for name in self.rank for i in range(len(name) - 1)}
        self.units_at_space = not any(a != SPACE and b == SPACE for a, b in self.pairs)
        self.identity = not self.charmap.units and not self.squeeze
        self.part = _Memo(self._word)
        self.word = _Memo(lambda word: self._word(SPACE + word))  # keys without the mark take half the memory

    # ---- normalisation -------------------------------------------------------------------------
    def normalize(self, text: str) -> tuple[str, list[int], list[int]]:
        """Normalised text and, per normalised character, its original byte span (begins, ends)."""
        data, at = text.encode("utf-8"), 0
        chars, begins, ends = [], [], []
        if self.dummy and data:
            chars, begins, ends = [SPACE], [0], [0]
        while at < len(data):
            hit = self.charmap.longest(data, at)
            if hit:
                size, new = hit[0], hit[1].decode("utf-8")
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new = data[at:at + size].decode("utf-8")
            for c in new.replace(" ", SPACE):
                if self.squeeze and c == SPACE and (not chars or chars[-1] == SPACE):
                    continue
                chars.append(c)
                begins.append(at)
                ends.append(at + size)
            at += size
        if self.squeeze:
            while chars and chars[-1] == SPACE:
                chars.pop(), begins.pop(), ends.pop()
        return "".join(chars), begins, ends

    # ---- segmentation --------------------------------------------------------------------------
    def _merge(self, unit: str) -> bytes:
        """Packed ids of one unit: merge the best pair, leftmost of equals, until none is a piece."""
        rank, parts = self.rank, list(unit)
        if len(parts) > 60:
            parts = self._merge_long(parts)
        elif len(parts) > 1:
            get = rank.get
            costs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            while costs and (best := min(costs)) != NEVER:
                at = costs.index(best)
                parts[at] += parts.pop(at + 1)
                del costs[at]
                if at:
                    costs[at - 1] = get(parts[at - 1] + parts[at], NEVER)
                if at < len(costs):
                    costs[at] = get(parts[at] + parts[at + 1], NEVER)
        ids: list[int] = []
        for p in parts:
            if p in self.ids:
                ids.append(self.ids[p])
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in p.encode("utf-8"))
            else:
                ids.append(self.unknown)
        return array("i", ids).tobytes()

    def _merge_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank, len(parts)
        left, right, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def push(i: int) -> None:
            j = right[i]
            if j < n:
                both = parts[i] + parts[j]
                if both in rank:
                    heapq.heappush(heap, (rank[both], i, j, both))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        return [p for p in parts if p]

    def _word(self, word: str) -> bytes:
        """Packed ids of a stretch whose outer borders no piece crosses, cut at its inner borders."""
        if word[1:].isalnum() and word[:2] in self.pairs:
            return self._merge(word)
        parts = [""]
        for run in RUNS.findall(word):
            for piece in (run,) if run.isalnum() else run:
                if parts[-1] and parts[-1][-1] + piece[0] not in self.pairs:
                    parts.append(piece)
                else:
                    parts[-1] += piece
        if len(parts) == 1:
            return self._merge(word)
        return b"".join([self.word[p[1:]] if p[0] == SPACE else self.part[p] for p in parts])

    def encode(self, text: str | None, spans: bool = True):
        """Ids (numpy int32, no end id) and, with ``spans``, begins and ends of the pieces in bytes."""
        text = text or ""
        if not text:
            empty = np.zeros(0, np.int32)
            return (empty, empty, empty) if spans else empty
        if self.identity and self.units_at_space and self.dummy and SPACE not in text:
            words = text.split(" ")
            if "" in words:  # runs of spaces: each space before another belongs to the next word
                found, run = [], ""
                for i, w in enumerate(words):
                    if w or i == len(words) - 1:
                        found.append(self.part[run + SPACE + w] if run else self.word[w])
                        run = ""
                    else:
                        run += SPACE
            else:
                found = map(self.word.__getitem__, words)
            ids = np.frombuffer(b"".join(found), np.int32)
            if not spans:
                return ids
            ends = np.cumsum(self.width[ids]) - 1  # the dummy space has no byte
            begins = np.concatenate(([0], ends[:-1]))
            return ids, begins.astype(np.int32), ends.astype(np.int32)
        norm, begin, end = self.normalize(text)
        ids = np.frombuffer(self._word(norm), np.int32) if norm else np.zeros(0, np.int32)
        if not spans:
            return ids
        return (ids, *self._project(ids, norm, begin, end))

    def _project(self, ids, norm: str, begin, end):
        """Spans of pieces over an aligned text; byte pieces of one character split its last bytes."""
        begins, ends, at, done = [], [], 0, 0
        for i in ids.tolist():
            if i in self.is_byte:
                size = len(norm[at].encode("utf-8"))
                done += 1
                last = done == size
                same = end[at] - begin[at] == size  # the character is unchanged: one byte each
                begins.append(begin[at] + done - 1 if same else begin[at])
                ends.append(begin[at] + done if same else end[at])
                if last:
                    at, done = at + 1, 0
                continue
            # An unknown piece is one character, any other as many as it is long.
            size = 1 if i == self.unknown else len(self.names[i])
            begins.append(begin[at])
            ends.append(end[at + size - 1])
            at += size
        return np.array(begins, np.int32), np.array(ends, np.int32)

    # ---- decoding ------------------------------------------------------------------------------
    def decode(self, ids) -> str:
        ids = ids.tolist() if hasattr(ids, "tolist") else list(ids)
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy or self.squeeze:
            first = next((i for i in ids if self.surface[i]), None)
            if first is not None and self.names[first].startswith(SPACE):
                raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:  # bytes that form no character read as U+FFFD each
            out, at = [], 0
            while at < len(raw):
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                try:
                    out.append(raw[at:at + size].decode("utf-8"))
                    at += size
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            return "".join(out)


def model_of(blob: bytes) -> PieceModel:
    """The model of a task's process, built once."""
    return held(hashlib.sha256(blob).digest(), lambda: PieceModel(blob))


SCHEMA = "ids array<int>, begins array<int>, ends array<int>, decoded string"


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: bool = True) -> DataFrame:
    """Encode and decode every text.

    Returns ``id_col``, ``ids`` (with the end id when asked), ``begins`` and ``ends`` (byte span of
    each piece in the UTF-8 text; the end id has an empty span at the end) and ``decoded``.  One
    output row per input row, in place: no shuffle.  Repeated rows give repeated results; other
    columns of ``docs`` are not read.  The model file is read once by the driver and travels with
    the function (its size does not depend on the data).
    """
    with open(model_path, "rb") as f:
        blob = f.read()
    slim = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    schema = T.StructType([slim.schema[id_col], *T.StructType.fromDDL(SCHEMA).fields])

    def run(keys, texts):
        model = model_of(blob)
        ids, begins, ends, decoded, sizes = [], [], [], [], []
        for text in texts:
            i, b, e = model.encode(text)
            decoded.append(model.decode(i))
            if end_id:
                n = len((text or "").encode("utf-8"))
                i, b, e = np.append(i, np.int32(model.end)), np.append(b, np.int32(n)), np.append(e, np.int32(n))
            ids.append(i), begins.append(b), ends.append(e), sizes.append(len(i))
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int32)
        return [keys, *[list_array(cat(xs), sizes, pa.int32()) for xs in (ids, begins, ends)], decoded]

    return map_rows(slim, run, schema, rows_per_step=256)
