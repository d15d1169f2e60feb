"""Exact dedup by Patricia tries: each distinct text is a terminal of a compressed radix trie that owns its copies.

Every input partition first inserts its texts into a trie of its own, so a text crosses the network
once for each partition that has it, however many copies there are.  These are dealt by length and
content hash, and each partition inserts the full byte strings into one trie, whose terminals keep the
owner and the number of rows.  A trie that outgrows its budget spills a heavy subtree: the subtree's
texts, and all later ones under it, go to the next round, which deals them again to as many tasks as
they need.  Tries say which terminal each row met; these links are rows of a table and lead back from
the owners to the documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .store import bounded_batches, drop, written


@dataclass(frozen=True)
class Limits:
    trie_bytes: int = 128 << 20  # a task's trie spills a subtree beyond this
    part_bytes: int = 64 << 20  # texts that a task of a later round should get
    emit_bytes: int = 16 << 20  # texts in an Arrow batch


class Node:
    __slots__ = ("label", "kids", "number", "owner", "row", "n", "gone")

    def __init__(self, label: bytes):
        self.label, self.kids, self.number, self.owner, self.row, self.n, self.gone = label, {}, -1, None, -1, 0, False


#: About the bytes of a node beside its label, and of a row that describes one.
NODE_BYTES = 300


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, known to be shorter than the label."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if text.startswith(label[low:mid], at + low) else (low, mid - 1)
    return low


class Trie:
    """A compressed radix trie over byte strings; ``bytes`` is about what it holds in memory."""

    def __init__(self):
        self.root, self.bytes, self.ends = Node(b""), NODE_BYTES, 0

    def find(self, text: bytes) -> Node:
        """The node on which ``text`` ends, made where there is none; or the stub of a spilled subtree above it."""
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.bytes += len(text) - at + NODE_BYTES
                return kid
            if not text.startswith(kid.label, at):
                n = _shared(kid.label, text, at)
                fork = node.kids[text[at]] = Node(kid.label[:n])
                kid.label = kid.label[n:]
                fork.kids[kid.label[0]] = kid
                self.bytes += NODE_BYTES
                kid = fork
            node, at = kid, at + len(kid.label)
            if node.gone:
                return node
        return node

    def walk(self, top: Node, path: bytes) -> Iterator[tuple[Node, bytes]]:
        """Nodes below ``top``, whose own path is ``path``, with their whole texts."""
        todo = [(top, path)]
        while todo:
            node, text = todo.pop()
            yield node, text
            todo += [(kid, text + kid.label) for kid in node.kids.values()]

    def heaviest(self, bytes_wanted: int) -> tuple[Node, bytes]:
        """A subtree down the heaviest path that fits into ``bytes_wanted`` (or a leaf), but never with all terminals."""
        order, weight, ends = [self.root], {}, {}
        for node in order:
            order += node.kids.values()
        for node in reversed(order):
            weight[id(node)] = len(node.label) + NODE_BYTES + sum(weight[id(k)] for k in node.kids.values())
            ends[id(node)] = (node.number >= 0) + sum(ends[id(k)] for k in node.kids.values())
        node, path = self.root, b""
        while node.kids and (weight[id(node)] > bytes_wanted or ends[id(node)] == self.ends):
            node = max(node.kids.values(), key=lambda k: (ends[id(k)] > 0, weight[id(k)], k.label))
            path += node.label
        return node, path

    def cut(self, top: Node) -> None:
        """Leave ``top`` as the stub of a spilled subtree.

        Its first byte is enough: all texts so far that take this edge are in the subtree.
        """
        for node, _ in self.walk(top, b""):
            self.bytes -= NODE_BYTES + len(node.label)
            self.ends -= node.number >= 0
        self.bytes += NODE_BYTES + 1
        top.label, top.kids, top.number, top.gone = top.label[:1], {}, -1, True


#: ref: a row of the round's input; cls: the terminal that it met, or that this row describes.
def _schema(id_field: StructField) -> StructType:
    longs = [StructField(c, LongType()) for c in ("ref", "cls", "row", "n", "length", "hash")]
    return StructType([*longs, StructField("owner", id_field.dataType), StructField("text", BinaryType()), StructField("sha", StringType())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _insert(round_no: int, smallest: bool, limits: Limits, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one partition into a trie: a link for each row, and a class row for each terminal.

    Round 0 reads documents and its class rows all carry their text to round 1, so a full trie is
    emptied.  Later rounds spill subtrees: class rows with a text are not finished.
    """

    def better(a_owner, a_row: int, b_owner, b_row: int) -> bool:
        if a_owner is None or b_owner is None:
            return b_owner is None and (a_owner is not None or a_row < b_row)
        return a_row < b_row if a_owner == b_owner else (a_owner < b_owner) == smallest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (round_no << 58) | (TaskContext.get().partitionId() << 34)
        trie, made, seen = Trie(), 0, 0
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            nonlocal out, held
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            out, held = [], 0
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        def describe(node: Node, text: bytes, onward: bool) -> None:
            nonlocal held
            key = _signed(xxhash.xxh3_64_intdigest(text)) if onward else None
            sha = None if onward else hashlib.sha256(text).hexdigest()
            out.append((None, node.number, node.row, node.n, len(text), key, node.owner, text if onward else None, sha))
            held += len(text) * onward + NODE_BYTES

        for got in batches:
            names = got.schema.names
            texts = got.column(names.index("text")).cast(pa.binary()).to_pylist()
            owners = got.column(names.index("owner")).to_pylist()
            refs, rows, counts = ([None] * len(texts),) * 3 if not round_no else (got.column(names.index(c)).to_pylist() for c in ("cls", "row", "n"))
            for text, owner, ref, row, n in zip(texts, owners, refs, rows, counts, strict=True):
                if not round_no:
                    text, ref, row, n = (text or b"").lower(), base + seen, base + seen, 1
                    seen += 1
                node = trie.find(text)
                if node.number < 0 or node.gone:
                    number, made = base + made, made + 1
                    if node.gone:
                        alone = Node(b"")
                        alone.number, alone.owner, alone.row, alone.n = number, owner, row, n
                        describe(alone, text, True)
                    else:
                        node.number, node.owner, node.row, node.n = number, owner, row, n
                        trie.ends += 1
                else:
                    number, node.n = node.number, node.n + n
                    if better(owner, row, node.owner, node.row):
                        node.owner, node.row = owner, row
                out.append((ref, number, None, None, None, None, None if round_no else owner, None, None))
                held += 100
                if trie.bytes > limits.trie_bytes:
                    if not round_no:
                        for end, whole in trie.walk(trie.root, b""):
                            if end.number >= 0:
                                describe(end, whole, not round_no)
                                if held > limits.emit_bytes:
                                    yield batch()
                        trie = Trie()
                    elif trie.ends > 1:
                        top, path = trie.heaviest(limits.trie_bytes // 2)
                        for end, whole in trie.walk(top, path):
                            if end.number >= 0:
                                describe(end, whole, True)
                                if held > limits.emit_bytes:
                                    yield batch()
                        trie.cut(top)
                if held > limits.emit_bytes:
                    yield batch()
        for end, whole in trie.walk(trie.root, b""):
            if end.number >= 0:
                describe(end, whole, not round_no)
                if held > limits.emit_bytes:
                    yield batch()
        if out:
            yield batch()

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", limits: Limits = Limits()) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) of every row of ``docs``, dropped ones included.

    Texts are equal when identical after lower-casing A-Z; null is an empty text and equal to it.  Of
    equal texts the row with the smallest (or ``largest``) id stays; null ids come after all others, and
    of rows with one id, or none, the first read stays, so exactly one row of each group is kept and
    keep_id is null only where no row of the group has an id.  An empty table gives an empty result;
    other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(docs[id_col].alias("owner"), docs[text_col].cast("string").alias("text"))
    schema = _schema(rows.schema["owner"])
    arrow = pa.schema([pa.field(f.name, _arrow_type(f)) for f in schema])
    rounds = [written(rows.mapInArrow(_insert(0, keep == "smallest", limits, arrow), schema))]
    while True:
        texts = rounds[-1].where("text is not null").select("cls", "row", "n", "length", "hash", "owner", "text")
        n, size = texts.agg(F.count("*"), F.sum("length")).first()
        if not n:
            break
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / limits.part_bytes))
        dealt = texts.repartition(parts, "length", "hash")
        rounds.append(written(dealt.mapInArrow(_insert(len(rounds), keep == "smallest", limits, arrow), schema)))
    ends = None
    for table in reversed(rounds[1:]):
        done = table.where("cls is not null and ref is null and text is null").select("cls", F.col("owner").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"))
        done = done if ends is None else done.unionByName(ends.withColumnRenamed("ref", "cls"))
        links = table.where("ref is not null").select("ref", "cls")
        ends = links.join(done, "cls").drop("cls")
    members = rounds[0].where("ref is not null").select(F.col("ref").alias("at"), F.col("cls").alias("ref"), F.col("owner").alias(id_col))
    if ends is None:
        found = members.select(id_col, F.lit(None).cast(schema["owner"].dataType).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
    else:
        found = members.join(ends, "ref").select(id_col, "keep_id", "group_size", (F.col("at") == F.col("keep_row")).alias("kept"), "text_sha256")
    found = written(found)
    for table in rounds:
        drop(table)
    return found


def _arrow_type(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
