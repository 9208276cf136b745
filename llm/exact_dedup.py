"""Operator 1, exact dedup: Patricia-trie owners.

Rows are dealt by length and content hash. Each partition inserts the full
byte strings into a compressed radix trie; a terminal node keeps the winning
row, the number of copies and how many rows are equal to the winning one. When a trie holds more bytes than its
budget its largest subtree is written to a task-local file and finished later.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, utf8, with_found

#: The row of a group that stays: its identifier, and the SHA-256 of its text as it stands.
Owner = tuple[int | None, str]
Entry = tuple[bytes, Owner, int, int]


def _larger(a: Owner, b: Owner) -> Owner:
    return max(a, b, key=lambda o: (o[0] is not None, o[0] or 0, o[1]))


def _smaller(a: Owner, b: Owner) -> Owner:
    return min(a, b, key=lambda o: (o[0] is None, o[0] or 0, o[1]))


KEEP: dict[str, Callable[[Owner, Owner], Owner]] = {"largest": _larger, "smallest": _smaller}


class _Node:
    __slots__ = ("label", "children", "owner", "count", "own")

    def __init__(self, label: bytes, owner: Owner | None = None, count: int = 0, own: int = 0):
        self.label, self.children, self.owner, self.count, self.own = label, {}, owner, count, own


def _shared_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """A compressed radix trie over byte strings with owners at its terminals.

    ``budget`` bounds the label bytes held in memory. Subtrees are told apart
    by the byte at ``depth``; every key of one trie agrees before that byte.
    """

    def __init__(self, keep: Callable, budget: int, depth: int = 0):
        self.keep, self.budget, self.depth = keep, budget, depth
        self.roots: dict[int, _Node] = {}
        self.held: dict[int, int] = {}
        self.files: dict[int, object] = {}

    def insert(self, key: bytes, owner: Owner, count: int, own: int) -> None:
        branch = key[self.depth] if len(key) > self.depth else -1
        if branch in self.files:
            pickle.dump((key, owner, count, own), self.files[branch])
            return
        root = self.roots.get(branch)
        if root is None:
            root = self.roots[branch] = _Node(b"")
        self.held[branch] = self.held.get(branch, 0) + self._walk(root, key, owner, count, own)
        if sum(self.held.values()) > self.budget and branch != -1:
            self._spill()

    def _walk(self, node: _Node, key: bytes, owner: Owner, count: int, own: int) -> int:
        """Insert below ``node``; returns the label bytes added."""
        at = 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], owner, count, own)
                return len(key) - at + 64
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            same = _shared_length(child.label, key[at:])
            middle = _Node(child.label[:same])
            child.label = child.label[same:]
            middle.children[child.label[0]] = child
            node.children[middle.label[0]] = middle
            at += same
            node = middle
        if node.count and node.owner == owner:
            node.own += own
        elif not node.count or self.keep(node.owner, owner) == owner:
            node.owner, node.own = owner, own
        node.count += count
        return 0

    @staticmethod
    def _entries(root: _Node) -> Iterator[Entry]:
        stack = [(root, b"")]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.count:
                yield key, node.owner, node.count, node.own
            stack.extend((child, key) for child in node.children.values())

    def _spill(self) -> None:
        branch = max((b for b in self.held if b != -1), key=self.held.get)
        out = tempfile.TemporaryFile()
        for entry in self._entries(self.roots.pop(branch)):
            pickle.dump(entry, out)
        self.held.pop(branch)
        self.files[branch] = out

    @staticmethod
    def _reread(file) -> Iterator[Entry]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return

    def finish(self) -> Iterator[Entry]:
        """Each distinct key once, with its owner and count; spilled subtrees last."""
        for root in self.roots.values():
            yield from self._entries(root)
        self.roots.clear()
        for file in self.files.values():
            prefix: bytes | None = None
            for key, *_ in self._reread(file):
                prefix = key if prefix is None else prefix[: _shared_length(prefix, key)]
            deeper = PatriciaTrie(self.keep, self.budget, len(prefix or b""))
            for entry in self._reread(file):
                deeper.insert(*entry)
            file.close()
            yield from deeper.finish()


def _normalise(body: bytes) -> bytes:
    return body.lower()  # on bytes: A-Z only


def _owners(docs: DataFrame, id_col: str, text_col: str, keep: str, trie_budget: int) -> DataFrame:
    """Of each distinct text ``_OWNERS``, a written table."""
    choose = KEEP[keep]
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"), F.sha2(utf8(text_col), 256).alias("raw"))

    def combined(batches):
        """Copies inside a task meet here, so a hot group shuffles a row per task."""
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            keys = list(held)
            idents, raws = zip(*(v[0] for v in held.values()))
            return pa.RecordBatch.from_arrays(
                [pa.array([len(k) for k in keys], pa.int64()),
                 pa.array([xxhash.xxh64_intdigest(k) >> 1 for k in keys], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(idents, pa.int64()), pa.array(raws, pa.string()),
                 pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[2] for v in held.values()], pa.int64())],
                names=["text_bytes", "h", "body", "owner", "raw", "n", "own"])

        for batch in batches:
            for ident, body, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "raw"))):
                key, new = _normalise(body), (ident, raw)
                found = held.get(key)
                if found is None:
                    held[key] = [new, 1, 1]
                    size += len(key)
                    continue
                found[1] += 1
                if found[0] == new:
                    found[2] += 1
                elif choose(found[0], new) == new:
                    found[0], found[2] = new, 1
            if size > 32 << 20:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    def owned(batches):
        trie = PatriciaTrie(choose, trie_budget)
        for batch in batches:
            for key, ident, raw, n, own in zip(*(batch.column(c).to_pylist() for c in ("body", "owner", "raw", "n", "own"))):
                trie.insert(key, (ident, raw), n, own)
        out: list[tuple] = []
        for key, (ident, raw), n, own in trie.finish():
            out.append((len(key), hashlib.sha256(key).hexdigest(), ident, raw, n, own))
            if len(out) == 10_000:
                yield _owner_batch(out)
                out = []
        if out:
            yield _owner_batch(out)

    dealt = rows.mapInArrow(combined, "text_bytes long, h long, body binary, owner long, raw string, n long, own long").repartition(parts, "text_bytes", "h")
    return materialize(dealt.mapInArrow(owned, _OWNERS), "exact-owners")


_OWNERS = "text_bytes long, text_sha256 string, keep_id long, keep_raw string, group_size long, keep_rows long"


def _owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _OWNERS.split(", ")])


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_budget: int = 64 << 20
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. ``keep`` names which
    identifier owns a group. Defined results: a null text counts as empty, so
    null and empty texts are one group; null ids lose to any other id, and a
    group of null ids only keeps all its rows; rows repeated with the same id
    share their verdict, each counting in ``group_size``; an empty table gives
    an empty result; other columns are not read.
    """
    def keyed(batches):
        for batch in batches:
            norm = [_normalise(b) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(b) for b in norm], pa.int64()),
                 pa.array([hashlib.sha256(b).hexdigest() for b in norm], pa.string())],
                names=["doc_id", "text_bytes", "text_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    members = rows.mapInArrow(keyed, "doc_id long, text_bytes long, text_sha256 string")
    joined = with_found(members, _owners(docs, id_col, text_col, keep, trie_budget), ["text_bytes", "text_sha256"], "group_size")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_budget: int = 64 << 20
) -> DataFrame:
    """One row of ``docs`` for each distinct text, columns unchanged.

    It has the group's ``keep_id``; of several such rows the text with the
    largest SHA-256 (the smallest if the smallest id stays), and of rows equal
    in both any one. Null ids lose to others but one row stays of a group of
    only null ids. The join is by text and id, so a hot text's rows are spread.
    """
    owners = _owners(docs, id_col, text_col, keep, trie_budget).select("keep_raw", "keep_id", "keep_rows")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = [F.sha2(utf8(f"row.{text_col}"), 256) == F.col("keep_raw"), F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("keep_id"))]
    met = rows.join(owners, same)
    one_of = met.filter("keep_rows > 1").groupBy("keep_raw", "keep_id").agg(F.first("row").alias("row")).select("row")
    return met.filter("keep_rows = 1").select("row").union(one_of).select("row.*")
