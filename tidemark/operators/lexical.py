"""Near-copies of canonical texts: which items are all but equal to an entry, or hold it.

Every item is held against the whole index in one pass. Upper bounds on both
ratios, computed for all entries at once, leave out what cannot pass; only the
rest is compared letter by letter, so no pair is lost and few are compared:

* ``token_set_ratio``: shared tokens and their letters give the parts that
  follow from lengths; the ratio of whole texts is bounded by lengths and by
  letters in common, whatever their order.
* ``partial_ratio``: a stretch of m letters that shares c of them in order with
  a text of n has at least 5c - 2m - 2n - 2 trigrams of that text, as a letter
  without partner breaks three trigrams and a skipped one two. They must lie
  within one stretch, so hits are counted in blocks of 16 places. What is left is
  bounded by what an entry shares in order with windows that cover all stretches,
  for many entries and windows at once; letters of one bucket count as equal there.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy, scan, text

#: Trigrams and letters are held by bucket; two in one bucket only raise a bound.
GRAM_BUCKETS = 1 << 16
LETTER_BUCKETS = 64
BLOCK = 16
#: Places of an item's text that are looked at together.
CHUNK = 4096
#: Letters of an entry in one number, whose last bit is a carry; and the longest entries whose letters are.
WORD = 63
LONGEST = 8 * WORD
#: Starts of stretches that a window covers; then what is left, more closely. Entries of so similar lengths have the same windows.
STEPS = (16, 4)
APART = 16
#: Pairs of an entry and a window that are looked at together.
CELLS = 1 << 13
#: Texts that are held against an index together.
TEXTS = 256
#: Entries of an index that are held together.
ENTRIES = 4096

MATCH = "id long, pos long, token_set double, partial double"


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each place; a text of two letters has none."""
    if len(codes) < 3:
        return np.empty(0, np.int64)
    return (codes[:-2] * 7919 + codes[1:-1] * 271 + codes[2:]) % GRAM_BUCKETS


def _letters(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes % LETTER_BUCKETS, minlength=LETTER_BUCKETS)


class Index:
    """Canonical texts of entries, by token, by trigram and by letter."""

    def __init__(self, pos: list[int], canon: list[str]):
        self.pos, self.canon = np.array(pos, np.int64), canon
        coded = [_codes(c) for c in canon]
        self.length = np.array([len(c) for c in coded], np.int64)
        self.letters = np.array([_letters(c) for c in coded], np.int64).reshape(len(canon), LETTER_BUCKETS)
        by_token: dict[str, list[int]] = defaultdict(list)
        tokens = [set(c.split()) for c in canon]
        for i, own in enumerate(tokens):
            for t in own:
                by_token[t].append(i)
        self.by_token = {t: np.array(of, np.int64) for t, of in by_token.items()}
        self.n_tokens = np.array([len(t) for t in tokens], np.int64)
        grams = [np.unique(_trigrams(c)) for c in coded]
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        every = np.concatenate(grams) if grams else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.entry, self.first = of[order], np.searchsorted(every[order], np.arange(GRAM_BUCKETS + 1))
        # where an entry has a letter: bits by word of the entry, letter and entry; the last letter is none
        short = np.flatnonzero(self.length <= LONGEST)
        self.where = np.zeros((-(-int(self.length[short].max(initial=1)) // WORD), LETTER_BUCKETS + 1, len(canon)), np.uint64)
        for e in short.tolist():
            at = np.arange(len(coded[e]))
            np.bitwise_or.at(self.where[:, :, e], (at // WORD, coded[e] % LETTER_BUCKETS), np.uint64(1) << (at % WORD).astype(np.uint64))

    def shared_tokens(self, tokens: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per entry: tokens in common, and the length of those joined by spaces."""
        n, size = len(self.pos), np.zeros(len(self.pos))
        hits = [(self.by_token[t], len(t) + 1) for t in tokens if t in self.by_token]
        if not hits:
            return np.zeros(n, np.int64), size
        of = np.concatenate([h for h, _ in hits])
        weight = np.repeat([w for _, w in hits], [len(h) for h, _ in hits])
        count = np.bincount(of, minlength=n)
        return count, np.maximum(np.bincount(of, weight, n) - 1, 0)

    def may_equal(self, canon: str, letters: np.ndarray, least: float) -> np.ndarray:
        """Entries whose ``token_set_ratio`` may reach ``least``."""
        tokens, la, lb = set(canon.split()), len(canon), self.length
        count, shared = self.shared_tokens(tokens)
        contained = (count > 0) & ((count == len(tokens)) | (count == self.n_tokens))
        by_shared = (count > 0) & ((200 * shared >= least * (shared + la)) | (200 * shared >= least * (shared + lb)))
        by_length = 200 * np.minimum(la, lb) >= least * (la + lb)
        near = np.flatnonzero(by_length)
        common = np.minimum(self.letters[near], letters).sum(1)
        by_letters = np.zeros(len(lb), bool)
        by_letters[near] = 200 * common >= least * (la + lb[near])
        return np.flatnonzero(contained | by_shared | by_letters)

    def hits(self, grams: np.ndarray, at: int, blocks: int) -> np.ndarray:
        """Per entry and block: places of ``grams`` whose trigram the entry has; ``at`` is the first one's place in its block."""
        n = self.first[grams + 1] - self.first[grams]
        flat = np.repeat(self.first[grams] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        block = np.repeat((np.arange(len(grams)) + at) // BLOCK, n)
        return np.bincount(self.entry[flat] * blocks + block, minlength=len(self.pos) * blocks).reshape(-1, blocks)

    def may_hold(self, codes: np.ndarray, letters: np.ndarray, least: float) -> np.ndarray:
        """Entries whose ``partial_ratio`` may reach ``least``."""
        r, la, lb = least / 200, len(codes), self.length
        short = np.minimum(la, lb)
        if r >= 1 or r <= 0.4:
            return np.arange(len(lb)) if r < 1 else np.empty(0, np.int64)  # the bounds say nothing
        shortest = short * r / (1 - r)  # of a stretch that can pass, and of what it shares
        enough = np.minimum(self.letters, letters).sum(1) >= shortest - 1e-6
        needed = (5 * r - 2) * (short + shortest) - 2 - 1e-6
        grams = _trigrams(codes)
        held = np.zeros(len(lb), bool) if len(grams) else needed <= 0
        span = -(-short // BLOCK) + 1  # blocks that a stretch touches at most
        widest = int(span.max(initial=1))
        step = max(CHUNK // BLOCK, widest)
        for lo in range(0, -(-max(len(grams), 1) // BLOCK), step):
            part = grams[lo * BLOCK : (lo + step + widest) * BLOCK]
            if not len(part):
                held |= needed <= 0
                continue
            blocks = -(-len(part) // BLOCK)
            upto = np.zeros((len(lb), blocks + 1), np.int64)
            np.cumsum(self.hits(part, 0, blocks), axis=1, out=upto[:, 1:])
            for k in np.unique(span):
                own = np.flatnonzero(span == k)
                ends = np.minimum(np.arange(blocks) + k, blocks)
                most = (upto[own][:, ends] - upto[own][:, :blocks]).max(1)
                held[own] |= most >= needed[own]
        # where the item is the shorter one, its trigrams stand for those of the stretch, each once
        longer = np.flatnonzero(enough & (lb > la))
        own = np.unique(grams)
        for e in longer.tolist():
            theirs = _trigrams(_codes(self.canon[e]))
            held[e] = np.isin(theirs, own).sum() >= needed[e]
        return np.flatnonzero(enough & held & (lb > 0))

    def in_order(self, entry: np.ndarray, start: np.ndarray, width: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """By pair of an entry and a window: how many letters they share in order, at most. ``letter``: the item's, by bucket."""
        common = np.empty(len(entry), np.int64)
        full, top, n = np.uint64((1 << WORD) - 1), np.uint64(WORD), len(self.pos)
        row = np.concatenate((letter, np.full(int(width.max(initial=0)), LETTER_BUCKETS))) * n
        order = np.lexsort((-width, self.length[entry] > 2 * WORD))
        for own in (order[at : at + CELLS] for at in range(0, len(order), CELLS)):
            words = -(-int(self.length[entry[own]].max()) // WORD)
            own = own[np.argsort(-width[own], kind="stable")]  # windows that end leave the arrays at their end
            e, at, ends = entry[own], start[own], -width[own]
            state = np.full((words, len(own)), full)  # a cleared bit is a matched letter
            has, sum_, carry = (np.empty(len(own), np.uint64) for _ in range(3))
            where = self.where[:words].reshape(words, -1)
            for j in range(-int(ends[0])):
                m = int(np.searchsorted(ends, -j))
                cell = row[at[:m] + j] + e[:m]
                u, t, c = has[:m], sum_[:m], carry[:m]
                for k in range(words):
                    s = state[k, :m]
                    np.take(where[k], cell, out=u, mode="clip")
                    u &= s
                    np.add(s, u, out=t)
                    if k:
                        t += c
                    if k < words - 1:
                        np.right_shift(t, top, out=c)
                    s -= u
                    s |= t
                    s &= full
            common[own] = words * WORD - np.bitwise_count(state).sum(0, dtype=np.int64)
        return common

    def windows(self, entries: np.ndarray, letter: np.ndarray, least: float, step: int) -> np.ndarray:
        """Entry, start, width and letters needed of the windows that have as many letters in common, whatever their order.

        Windows cover ``step`` stretches each, and those that an end of the text cuts.
        """
        r, la = least / 200, len(letter)
        used = np.unique(letter)
        upto = np.zeros((len(used), la + 1), np.int64)
        np.cumsum(letter == used[:, None], axis=1, out=upto[:, 1:])
        kind, pairs = -(-self.length[entries] // APART), [np.empty((4, 0), np.int64)]
        for own in (entries[kind == k] for k in np.unique(kind)):
            n = self.length[own]
            longest = int(n.max())
            start = np.arange(0, la - int(n.min()) + 1, step)
            start = np.concatenate((start, (0, max(0, la - longest))))
            width = np.append(np.full(len(start) - 2, longest + step - 1), (longest, longest))
            needed = np.repeat(np.ceil(2 * r * n - 1e-6)[:, None], len(start), 1)
            needed[:, -2:] = np.ceil(n * r / (1 - r) - 1e-6)[:, None]  # of a stretch that is cut
            has = (upto[:, np.minimum(start + width, la)] - upto[:, start]).astype(np.int16)
            common = np.zeros(needed.shape, np.int16)
            for theirs, ours in zip(self.letters[own][:, used].T.astype(np.int16), has):
                common += np.minimum(theirs[:, None], ours)
            e, w = np.nonzero(common >= needed)
            pairs.append(np.stack((own[e], start[w], width[w], needed[e, w].astype(np.int64))))
        return np.concatenate(pairs, axis=1)

    def may_hold_in_order(self, entries: list[np.ndarray], letters: list[np.ndarray], least: float, step: int) -> list[np.ndarray]:
        """By item, those of its ``entries``, none longer than it, whose ``partial_ratio`` may reach ``least``. Windows of all items are looked at together."""
        found = [self.windows(own, letter, least, step) if len(own) else np.empty((4, 0), np.int64) for own, letter in zip(entries, letters)]
        apart = np.full(max((int(f[2].max(initial=0)) for f in found), default=0), LETTER_BUCKETS)  # no window reaches the next item
        base = np.cumsum([0, *(len(letter) + len(apart) for letter in letters)])[:-1]
        item = np.repeat(np.arange(len(found)), [f.shape[1] for f in found])
        entry, start, width, needed = np.concatenate([np.empty((4, 0), np.int64), *found], axis=1)
        row = np.concatenate([x for letter in letters for x in (letter, apart)]) if letters else apart
        passed = self.in_order(entry, start + base[item], width, row) >= needed
        ends = np.searchsorted(item[passed], np.arange(len(found) + 1))
        return [np.unique(entry[passed][i:j]) for i, j in zip(ends[:-1], ends[1:])]

    def matches(self, canon: str, token_set: float, partial: float, met: np.ndarray | None = None) -> list[tuple[int, float, float]]:
        """``(entry, token_set_ratio, partial_ratio)`` where either reaches its bar; what does not is 0. ``met``: which entries are looked at, if not all."""
        return self.matches_of([canon], token_set, partial, [met])[0]

    def matches_of(self, canons: list[str], token_set: float, partial: float, met: list[np.ndarray | None]) -> list[list[tuple[int, float, float]]]:
        """``matches`` of each text. What is asked of few entries takes many small steps, so it is asked for all texts at once."""
        found: list[dict[int, list[float]]] = [{} for _ in canons]
        close, others, letters = [], [], []
        for canon, own, into in zip(canons, met, found):
            codes = _codes(canon)
            letters.append(codes % LETTER_BUCKETS)
            if not canon:
                close.append(np.empty(0, np.int64))
                others.append(close[-1])
                continue
            counts = _letters(codes)
            equal, hold = self.may_equal(canon, counts, token_set), self.may_hold(codes, counts, partial)
            if own is not None:
                equal, hold = equal[own[equal]], hold[own[hold]]
            into.update((int(e), [fuzzy.token_set_ratio(canon, self.canon[e], token_set), 0.0]) for e in equal)
            wide = self.length[hold] <= min(len(codes), LONGEST) if partial < 200 else np.zeros(len(hold), bool)
            close.append(hold[wide])
            others.append(hold[~wide])
        for step in STEPS if any(map(len, close)) else ():
            close = self.may_hold_in_order(close, letters, partial, step)
        for canon, hold, into in zip(canons, map(np.concatenate, zip(others, close)), found):
            for e in hold.tolist():
                into.setdefault(e, [0.0, 0.0])[1] = fuzzy.partial_ratio(canon, self.canon[e], partial)
        return [[(e, t, p) for e, (t, p) in sorted(own.items()) if t > 0 or p > 0] for own in found]


def near_copies(items: DataFrame, entries: DataFrame, token_set: float, partial: float, earlier: bool = False) -> DataFrame:
    """MATCH of every item and entry that pass either bar. ``items``: id, text; ``entries``: pos, text, an index whose size is checked.

    With ``earlier``, an entry of a position below 0 is met by items with an id over its amount only.
    Defined results: texts without a canonical token (null and empty ones too)
    match nothing; repeated items give their rows each.
    """
    rows = entries.select("pos", text.canonical(F.col("text")).alias("canon")).filter("canon <> ''").collect()
    rows.sort(key=lambda r: -r["pos"])  # those that the most items meet come first
    held = [rows[at : at + ENTRIES] for at in range(0, len(rows), ENTRIES)]
    indexes = entries.sparkSession.sparkContext.broadcast([Index([r["pos"] for r in own], [r["canon"] for r in own]) for own in held])

    def run(batches):
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            ids, canons = batch.column(0).to_pylist(), list(map(scan.canonical, batch.column(1).to_pylist()))
            asked = list(dict.fromkeys(zip(ids, canons)) if earlier else dict(zip(canons, zip(ids, canons))).values())
            found: dict[tuple[int, str] | str, list] = {key if earlier else key[1]: [] for key in asked}
            for index in indexes.value:
                met = [-index.pos < i if earlier else None for i, _ in asked]  # an index's own positions are above 0
                some = [k for k, own in enumerate(met) if own is None or own.any()]
                of = index.matches_of([asked[k][1] for k in some], token_set, partial, [met[k] for k in some])
                for k, own in zip(some, of):
                    found[asked[k] if earlier else asked[k][1]] += [(int(index.pos[e]), t, p) for e, t, p in own]
            out = [(i, *match) for i, canon in zip(ids, canons) for match in found[(i, canon) if earlier else canon]]
            if out:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "pos", "token_set", "partial"])

    # a text takes time that grows with the index
    texts = items.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.dealt(texts, "id", max(100, min(2000, 400_000 // max(1, len(rows))))).mapInArrow(run, MATCH)
