"""Operator 9, benchmark decontamination: q-gram lemma filtering.

Benchmark items are cut into overlapping windows. A document region can hold a
window within ``k`` edits only if it shares ``length - q + 1 - q*k`` character
q-grams with it on neighbouring diagonals. Those regions are kept and verified
by a banded alignment, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

Q = 8  # characters, that is code points, of a q-gram
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: A q-gram is hashed from its halves, these from theirs, and so on; hashes that
#: meet by chance add a candidate to verify and lose none.
_HALVES = [(1, np.uint64(0xD6E8FEB86659FD93)), (2, np.uint64(0xA0761D6478BD642F)), (4, np.uint64(0xE7037ED1A0B428DB))]
_SEPARATOR = 1  # between texts; folding leaves none of it in them
#: Q-grams in more places than FEW are left out of patterns that need more than
#: ENOUGH matches; about POSTINGS (pattern, place) pairs are held at once.
FEW, ENOUGH, POSTINGS = 16, 12, 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if chr(c).isalnum() else 32 for c in bytes(range(128)).lower()]


def _fold(raw: bytes) -> np.ndarray:
    """Code points of lower-cased UTF-8, every run of ASCII other than letters and digits one space."""
    if raw.isascii():
        t = _FOLD[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    else:
        t = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        t = np.where(t < 128, _FOLD[t & 127], t)
    space = t == 32
    keep = np.ones(len(t), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return t[keep]


def _folded(raw: bytes) -> np.ndarray:
    """``_fold`` without a space at either end."""
    text = _fold(raw)
    text = text[1:] if len(text) and text[0] == 32 else text
    return text[:-1] if len(text) and text[-1] == 32 else text


def _grams(text: np.ndarray) -> np.ndarray:
    """The hash of the q-gram at every position that has one."""
    if len(text) < Q:
        return np.empty(0, np.uint64)
    h = text.astype(np.uint64)
    for half, factor in _HALVES:
        h = h[:-half] * factor + h[half:]
    return h


class QGramIndex:
    """Windows of one block of benchmark items, and their q-grams.

    Equal windows are one pattern. Each pattern leaves out its most frequent
    q-grams as long as so many of the others must match that chance matches
    stay rare; a region within the edits has at least ``least`` of those.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], window: int, edit_rate: float):
        self.ids = [i for i, _ in items]  # may be null or repeat, so items go by number
        self.windows_of: dict[int, int] = {}
        self.whole: dict[bytes, list[int]] = {}  # items too short for a q-gram
        numbers: dict[bytes, int] = {}
        self.items_of: list[list[int]] = []  # of each pattern, an item once for each of its windows
        for item, (_, raw) in enumerate(items):
            text = _folded(raw)
            k = int(min(len(text), window) * edit_rate)
            if len(text) and min(len(text), window) - Q + 1 - Q * k < 1:
                self.whole.setdefault(text.tobytes(), []).append(item)
                continue
            starts = [0] if len(text) <= window else [*range(0, len(text) - window, window // 2), len(text) - window]
            for at in starts if len(text) else []:
                pattern = text[at : at + window].tobytes()
                number = numbers.setdefault(pattern, len(numbers))
                if number == len(self.items_of):
                    self.items_of.append([])
                self.items_of[number].append(item)
                self.windows_of[item] = self.windows_of.get(item, 0) + 1
        self.patterns = [np.frombuffer(p, np.uint32) for p in numbers]
        self.edits = [int(len(p) * edit_rate) for p in self.patterns]
        self.reach = max(map(len, self.patterns), default=0) + max(self.edits, default=0)
        self.step = max(self.edits, default=0) + 1
        grams = [_grams(p) for p in self.patterns]
        sizes = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        must = sizes - Q * np.array(self.edits, np.int64)
        spare = np.maximum(must - ENOUGH, 0)
        # a pattern's q-grams from the most frequent on; those in more than FEW places are left out first
        order = np.lexsort((-count[code], owner))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.zeros(len(flat), bool)
        out[order] = (rank < spare[owner]) & (count[code[order]] > FEW)
        self.least = must - np.bincount(owner, out, len(sizes)).astype(np.int64)
        keep = ~out
        flat, owner, offset = flat[keep], owner[keep], offset[keep]
        self.unique, code = np.unique(flat, return_inverse=True)
        order = np.lexsort((owner, code))
        self.width = max(len(sizes), 1)
        self.posting = code[order] * self.width + owner[order]  # sorted by q-gram, then pattern
        self.offset = offset[order].astype(np.int32)
        self.bits = max(16, int(len(self.unique) * 8).bit_length())
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.unique * _MULT) >> np.uint64(64 - self.bits)] = True

    def matches(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """``(pattern, start, edits)`` of every verified region of a folded text."""
        grams = _grams(text)
        if not len(grams) or not len(self.unique):
            return []
        maybe = np.flatnonzero(self.filter[(grams * _MULT) >> np.uint64(64 - self.bits)])
        at = np.searchsorted(self.unique, grams[maybe])
        at[at == len(self.unique)] = 0
        same = self.unique[at] == grams[maybe]
        pos, gram = maybe[same], at[same]
        # a region needs so many q-grams of any pattern before diagonals count
        least = int(self.least.min())
        if len(pos) < least:
            return []
        ends = np.searchsorted(pos, pos + self.reach)
        full = np.flatnonzero(ends - np.arange(len(pos)) >= least)
        if not len(full):
            return []
        edge = np.zeros(len(pos) + 1, np.int64)
        np.add.at(edge, full, 1)
        np.add.at(edge, ends[full], -1)
        dense = np.cumsum(edge[:-1]) > 0
        pos, gram = pos[dense], gram[dense]
        places = np.searchsorted(self.posting, (gram + 1) * self.width) - np.searchsorted(self.posting, gram * self.width)
        before = np.concatenate(([0], np.cumsum(places)))
        found: list[tuple[int, int, int]] = []
        lo = 0
        while lo < len(pos):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + POSTINGS, "right")) - 1)
            stop = int(np.searchsorted(pos, pos[hi - 1] + 1 + 2 * self.reach))  # regions that begin here end there
            found += self._regions(text, pos[lo:stop], gram[lo:stop], 0, self.width)
            lo = hi
        return sorted(set(found))

    def _regions(self, text: np.ndarray, pos: np.ndarray, gram: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
        """Matches of patterns ``low`` to ``high``; halved while their postings are too many to hold."""
        first = np.searchsorted(self.posting, gram * self.width + low)
        count = np.searchsorted(self.posting, gram * self.width + high) - first
        total = int(count.sum())
        if total > 2 * POSTINGS and high - low > 1:
            middle = (low + high) // 2
            return self._regions(text, pos, gram, low, middle) + self._regions(text, pos, gram, middle, high)
        where = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
        pattern = self.posting[where] % self.width
        band = (np.repeat(pos, count) - self.offset[where] + self.reach) // self.step
        key = pattern * np.int64(1 << 40) + band
        # bands are two steps wide and overlap by one, so k+1 diagonals fit in one of them
        one, times = np.unique(key, return_counts=True)
        beside = np.searchsorted(one, one + 1)
        beside[beside == len(one)] = 0
        twice = times + np.where(one[beside] == one + 1, times[beside], 0)
        # the band that ends with this step holds it and the one before; a step without one before it begins a band, too
        before = np.searchsorted(one, one - 1)
        before[before == len(one)] = 0
        alone = one[before] != one - 1
        keys = np.concatenate((one, one[alone] - 1))
        counts = np.concatenate((twice, times[alone]))
        keys = keys[counts >= self.least[np.clip(keys >> 40, 0, len(self.least) - 1)]]
        return self._verify(text, keys >> 40, (keys & ((1 << 40) - 1)) * self.step - self.reach)

    def _verify(self, text: np.ndarray, windows: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int]]:
        out = []
        shapes = {}
        for i, w in enumerate(windows.tolist()):
            shapes.setdefault((len(self.patterns[w]), self.edits[w]), []).append(i)
        for (length, k), rows in shapes.items():
            for lo in range(0, len(rows), 4096):
                some = rows[lo : lo + 4096]
                patterns = np.stack([self.patterns[w] for w in windows[some]])
                edits, start = _banded(text, patterns, diagonals[some] - k, 2 * self.step + 2 * k + 1)
                out += [(int(w), int(s), int(e)) for w, s, e in zip(windows[some], start, edits) if e <= k]
        return out


def _banded(text: np.ndarray, patterns: np.ndarray, diagonals: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Edits of the best alignment of each pattern that starts on one of ``width``
    diagonals and stays on them, and where that diagonal begins in the text."""
    n, length = patterns.shape
    slide = np.arange(width)
    cost = np.zeros((n, width), np.int16)
    for i in range(length):
        at = diagonals[:, None] + slide[None, :] + i
        inside = (at >= 0) & (at < len(text))
        differs = ~inside | (text[np.clip(at, 0, len(text) - 1)] != patterns[:, i : i + 1])
        new = cost + differs
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = (np.minimum.accumulate(new - slide, axis=1) + slide).astype(np.int16)
    best = cost.argmin(1)
    return cost[np.arange(n), best], np.maximum(diagonals + best, 0)


def _pieces(texts: list[np.ndarray], limit: int, overlap: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Groups of (text number, piece) of about ``limit`` folded characters; longer texts in overlapping pieces."""
    group, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text), 1), limit):
            piece = text[max(0, at - overlap) : at + limit]
            group.append((number, piece))
            size += len(piece)
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group


def _scan(index: QGramIndex, texts: list[bytes]) -> Iterator[tuple[int, int | None, int, int, int]]:
    """``(text number, item id, windows matched, windows, edits)`` of contaminated texts."""
    found: dict[tuple[int, int], dict[int, int]] = {}
    folded = [_folded(raw) for raw in texts]
    if index.whole:
        for number, text in enumerate(folded):
            for item in index.whole.get(text.tobytes(), ()):
                yield number, index.ids[item], 1, 1, 0
    for group in _pieces(folded, 2 << 20, 2 * (index.reach + index.step)):
        parts: list[np.ndarray] = []
        for _, piece in group:
            parts += [piece, np.full(1, _SEPARATOR, np.uint32)]
        begins = np.cumsum([0, *(len(p) + 1 for _, p in group)])
        for pattern, start, edits in index.matches(np.concatenate(parts)):
            number = group[int(np.searchsorted(begins, start, "right")) - 1][0]
            for item in index.items_of[pattern]:
                best = found.setdefault((number, item), {})
                best[pattern] = min(edits, best.get(pattern, edits))
    for (number, item), best in sorted(found.items()):
        shown = {p: index.items_of[p].count(item) for p in best}  # an item may repeat a window
        yield number, index.ids[item], sum(shown.values()), index.windows_of[item], sum(best[p] * n for p, n in shown.items())


def _indexes(benchmark: DataFrame, item_col: str, window: int, edit_rate: float, block_bytes: int) -> Iterator[QGramIndex]:
    """An index of each block of the benchmark; its memory is some 70 times the block's bytes."""
    block: list[tuple[int | None, bytes]] = []
    size = 0
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col("text").alias("t")).filter("t IS NOT NULL")
    for item in items.toLocalIterator():
        raw = _bytes_of(pa.array([item["t"]]))[0]
        if block and size + len(raw) > block_bytes:
            yield QGramIndex(block, window, edit_rate)
            block, size = [], 0
        block.append((item["i"], raw))
        size += len(raw)
    if block:
        yield QGramIndex(block, window, edit_rate)


def _bytes_of(column: pa.Array) -> list[bytes]:
    """Lower-cased UTF-8 of texts, null as empty. Items and documents both pass here: no two libraries lower every letter alike."""
    return pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")).cast(pa.binary()).to_pylist()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = 80,
    edit_rate: float = 1 / 16,
    block_bytes: int = 1 << 20,
) -> DataFrame:
    """``(doc_id, item_id, windows_found, windows, edits)`` per leaked item of a document.

    Texts are compared lower-cased, with runs of ASCII punctuation and space as
    one space. An item leaks when one of its windows (``window`` characters
    from every half window on, and the last ones; the whole item if shorter)
    occurs within ``edit_rate`` edits per character, so every verbatim passage
    of one and a half windows leaks, however long the item; the columns tell
    how much of the item was found. The benchmark is read in
    blocks of at most ``block_bytes`` of text (an item larger than that is a
    block), one pass over the documents each, so what executors are sent is
    bounded however large it is. Defined results: null and empty texts match
    nothing; items too short for a q-gram leak only in texts that are equal to
    them; equal items are reported each, also under equal or null ids; repeated
    rows are reported each; empty tables give an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, windows_found int, windows int, edits int"

    def scanner(index):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    hits = list(_scan(index.value, _bytes_of(part.column(1))))
                    if hits:
                        number, item, got, of, edits = zip(*hits)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(number)), pa.array(item, pa.int64()), pa.array(got, pa.int32()), pa.array(of, pa.int32()), pa.array(edits, pa.int32())],
                            names=["doc_id", "item_id", "windows_found", "windows", "edits"])

        return run

    out = None
    for index in _indexes(benchmark, item_col, window, edit_rate, block_bytes):
        found = rows.mapInArrow(scanner(spark.sparkContext.broadcast(index)), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = 80, edit_rate: float = 1 / 16, block_bytes: int = 1 << 20
) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, see ``contaminated``; columns unchanged.

    Each row is judged by its own text where it is read, so ids do not matter;
    between two blocks of the benchmark the rows left are written as a table.
    """
    place = docs.columns.index(text_col)

    def keeper(index):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    clean = np.ones(part.num_rows, bool)
                    clean[[number for number, *_ in _scan(index.value, _bytes_of(part.column(place)))]] = False
                    yield part.filter(pa.array(clean))

        return run

    kept = docs
    for k, index in enumerate(_indexes(benchmark, item_col, window, edit_rate, block_bytes)):
        kept = materialize(kept, "clean-rows") if k else kept
        kept = kept.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return kept
