"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For merge-type vocabularies each prefix of a text has exactly one valid encoding, so it has one last
token.  An automaton finds the tokens that end at a position; the one whose predecessor (the last
token of the remaining prefix) may stand beside it is the position's last token.  Two tokens may
stand beside each other if merging their joined text gives back exactly these two.  Walking the
table backwards recovers the ids.  Time and memory are linear in the text, however long a run
without spaces is.

Merges never cross a character that is in no piece, nor (in a vocabulary whose pieces have U+2581
only at their start) the border before U+2581, so each chunk between such borders is encoded alone
and short chunks are remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .store import bounded_batches

SPACE = "▁"
# Fixed values of the model format: piece types, and fields of its messages.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_SURFACE = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            if key & 7 == 2:
                n, i = number(i)
            else:
                n = {1: 8, 5: 4}[key & 7]
            value = data[i : i + n]
            i += n
        yield key >> 3, value


class PrefixTableCodec:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, model: bytes, remember: int = 1 << 18, remember_chars: int = 48) -> None:
        self.surface: list[bytes] = []  # what each id decodes to
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: list[int] = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.dummy_prefix, self.unknown = True, 0
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                name, kind, at = piece[1].decode(), piece.get(3, NORMAL), len(self.surface)
                self.surface.append(name.replace(SPACE, " ").encode())
                if kind == BYTE:
                    byte = int(name[3:5], 16)
                    self.byte_ids[byte], self.byte_of[at] = at, byte
                    self.surface[at] = bytes([byte])
                elif kind == UNKNOWN:
                    self.unknown, self.surface[at] = at, UNKNOWN_SURFACE.encode()
                elif kind == CONTROL:
                    self.surface[at] = b""
                elif kind == NORMAL:
                    self.ids[name], self.score[name] = at, struct.unpack("<f", piece[2])[0]
                else:
                    raise ValueError(f"piece type {kind} is not supported")
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only the identity normaliser that keeps all spaces is supported")
                self.dummy_prefix = bool(norm.get(3, 1))
            elif field == 2:
                train = dict(_fields(value))
                if train.get(3) != 2:
                    raise ValueError("only merge-type models are supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds U+2581 after another character")
        self.control = {i for i, b in enumerate(self.surface) if not b}
        self.chars = {c for p in self.ids for c in p}
        # characters that only occur inside pieces take part in merging, and become bytes where they stay alone
        self.alone = {len(self.surface) + k: c for k, c in enumerate(sorted(self.chars - self.ids.keys()))}
        self.part_ids = self.ids | {c: i for i, c in self.alone.items()}
        self.text = {i: p for p, i in self.part_ids.items()}
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.unmerged = re.compile(f"[^{re.escape(''.join(sorted(self.chars)))}]")
        self.automaton = ahocorasick.Automaton()
        self.split: dict[int, tuple[int, int]] = {}
        self.late: set[int] = set()  # pieces that do not come after both their halves
        for piece, i in self.ids.items():
            halves: list[str] = []
            if self.merge(piece, halves) != [i]:  # such a piece never comes out of merging
                continue
            self.automaton.add_word(piece, (i, len(piece)))
            if halves:
                self.split[i] = self.part_ids[halves[0]], self.part_ids[halves[1]]
                if any(len(h) > 1 and self.score[h] <= self.score[piece] for h in halves):
                    self.late.add(i)
        for i, c in self.alone.items():
            self.automaton.add_word(c, (i, 1))
        self.automaton.make_automaton()
        for i in sorted(self.split, key=lambda i: len(self.text[i])):
            if not self.late.isdisjoint(self.split[i]):
                self.late.add(i)
        self.pairs: dict[int, bool] = {}
        self.spaced: tuple[dict, dict] = {}, {}  # recent and older chunks that begin with U+2581, without it
        self.plain: tuple[dict, dict] = {}, {}
        self.remember, self.remember_chars = remember, remember_chars

    def merge(self, text: str, halves: list[str] | None = None) -> list[int]:
        """Ids by merging the best pair again and again; only for the short texts of one or two pieces.

        halves: gets the two parts of the last merge.
        """
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (piece := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[piece], i, piece))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, piece = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != piece:
                continue
            if halves is not None:
                halves[:] = parts[i], parts[j]
            parts[i], parts[j] = piece, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.part_ids.get(p, -1) for p in parts if p is not None]

    def _test(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay apart when their joined text is merged.

        Follows the border between them through time: on its left the growing right edge of ``a``,
        on its right the growing left edge of ``b``.  A piece across the border that is better than
        the next growth of either side would have been merged.
        """
        if a in self.late or b in self.late:
            return self.merge(self.text[a] + self.text[b]) == [a, b]
        lefts, rights = [a], [b]
        while lefts[-1] in self.split:
            lefts.append(self.split[lefts[-1]][1])
        while rights[-1] in self.split:
            rights.append(self.split[rights[-1]][0])
        text, score, never = self.text, self.score, float("-inf")
        x, y = lefts.pop(), rights.pop()
        while True:
            across = score.get(text[x] + text[y], never)
            grow_x = score[text[lefts[-1]]] if lefts else never
            grow_y = score[text[rights[-1]]] if rights else never
            if across > grow_x and across >= grow_y and across > never:
                return False
            if not lefts and not rights:
                return True
            if lefts and (not rights or grow_x >= grow_y):
                x = lefts.pop()
            else:
                y = rights.pop()

    def _table(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk of known characters."""
        last, length = [0] * (len(chunk) + 1), [0] * (len(chunk) + 1)
        pairs = self.pairs
        known = pairs.get
        for end, (token, n) in self.automaton.iter(chunk):  # at each end, longer tokens come first
            end += 1
            if length[end]:
                continue
            start = end - n
            if start:
                if not length[start]:
                    continue
                key = last[start] << 20 | token
                fits = known(key)
                if fits is None:
                    if len(pairs) > 1 << 20:
                        pairs.clear()
                    fits = pairs[key] = self._test(last[start], token)
                if not fits:
                    continue
            last[end], length[end] = token, n
        ids, at = [], len(chunk)
        while at:
            ids.append(last[at])
            at -= length[at]
        if self.alone:
            return tuple(chain.from_iterable([self.byte_ids[b] for b in self.alone[i].encode()] if i in self.alone else (i,) for i in reversed(ids)))
        return tuple(reversed(ids))

    def _part(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk that may hold characters outside all pieces; those become their bytes."""
        ids: list[int] = []
        at = 0
        for odd in self.unmerged.finditer(chunk):
            if odd.start() > at:
                ids += self._table(chunk[at : odd.start()])
            ids += [self.byte_ids[b] for b in odd[0].encode()]
            at = odd.end()
        if at < len(chunk):
            ids += self._table(chunk[at:])
        return tuple(ids)

    def _recall(self, memory: tuple[dict, dict], part: str, prefix: str) -> tuple[int, ...]:
        """Ids of a part that ``memory``'s recent half lacks."""
        recent, older = memory
        ids = older.get(part)
        if ids is None:
            ids = self._part(prefix + part)
        if len(part) <= self.remember_chars:
            if len(recent) >= self.remember:
                older.clear()
                older.update(recent)
                recent.clear()
            recent[part] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without begin or end; none for null and empty texts."""
        if not text:
            return []
        if self.dummy_prefix:
            text = " " + text
        out: list[tuple[int, ...]] = []
        spaced, plain, recall = self.spaced[0].get, self.plain[0].get, self._recall
        if "  " in text or SPACE in text or "\n " in text or " \n" in text or text[-1] == " ":
            for chunk in self.chunk.findall(text.replace(" ", SPACE)):
                out.append(plain(chunk) or recall(self.plain, chunk, ""))
        else:  # every space begins a chunk
            for i, line in enumerate(text.split("\n")):
                if i:
                    out.append((self.byte_ids[10],) if "\n" not in self.chars else self._part("\n"))
                first, *rest = line.split(" ")
                if first:
                    out.append(plain(first) or recall(self.plain, first, ""))
                out += [spaced(part) or recall(self.spaced, part, SPACE) for part in rest]
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that form no character become U+FFFD each, as in the library."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and raw[:1] == b" ":
            first = next(i for i in ids if i not in self.control)
            if first not in self.byte_of and first != self.unknown:
                raw = raw[1:]
        try:
            if self.control.isdisjoint(ids):
                return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_broken(raw)
        at, spans, start = 0, [], 0  # a control id ends a run of bytes
        skipped = sum(map(len, map(self.surface.__getitem__, ids))) - len(raw)
        for i in ids:
            at += len(self.surface[i])
            if i in self.control:
                spans.append(raw[max(0, start - skipped) : max(0, at - skipped)])
                start = at
        return "".join(map(self._decode_broken, [*spans, raw[max(0, start - skipped) :]]))

    @staticmethod
    def _decode_broken(raw: bytes) -> str:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode("utf-8"))
                break
            except UnicodeDecodeError as bad:
                out.append(raw[at : at + bad.start].decode("utf-8"))
                out.append("�")
                at += bad.start + 1
        return "".join(out)


_codecs: dict[bytes, PrefixTableCodec] = {}


def codec(model: bytes) -> PrefixTableCodec:
    """The worker's codec of a model; it is built once."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = PrefixTableCodec(model)
    return _codecs[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every row of ``docs``.

    Null texts count as empty; empty texts have no tokens and decode to the empty text.  Repeated
    rows and null ids are kept; other columns are ignored; an empty table gives an empty result.
    The model file is read on the driver and broadcast: its size is that of one fixed vocabulary.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    fields = [StructField(id_col, kind), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if keep_ids:
        fields += [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model.value)
        decimal = [str(i) for i in range(len(one.surface))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, enc, dec, kept, texts = [], [], [], [], []
            for cell in batch.column(1):
                ids = one.encode(cell.as_py())
                text = one.decode(ids)
                n.append(len(ids))
                enc.append(sha(",".join(map(decimal.__getitem__, ids))))
                dec.append(sha(text))
                if keep_ids:
                    kept.append(ids)
                    texts.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())]
            if keep_ids:
                columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, StructType(fields))
