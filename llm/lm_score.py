"""Operator 7, LM scoring: causal self-attention over subword ids.

A text is its words and an end; a word is its subword ids, of which only the
first begins with a space. The model gives every id a probability in three
steps, P(group | context) P(class | group, context) P(id | class, class of the
id before). The first two come from a self-attention network, trained in numpy,
that reads overlapping windows: a block of positions attends to itself and the
block before it, and every id is scored once, in the block it lies in. The last
comes from counts. Since groups hold either only ids that begin a word or only
ids that do not, the network also gives the probability that a word ends, so a
word's ids and its end make a probability over words. ``score`` mixes it with
the word's share of all training words; ``attention_score`` is the network's.

Everything is learned from all training text. Slices of the texts are coded
once and written as a table. Counts are vectors summed over tasks in a tree. In
a round of training every task follows the gradients over its own slices, and
the rounds' models are averaged; over all rounds each slice is read once, but
for the one the first round starts with, which is read twice.

Words meet as packed lists, one for each slice and bucket of words; the bucket
answers with counts in the order of the list, so words are shuffled once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, materialize, shuffle_partitions, utf8
from .subwords import default_vocabulary, encoder, slices

BLOCK = 16  # positions scored together; their window has the block before, too
IDS = 50_257
END = 50_256  # free in the vocabulary: ends a text, and stands before it
MEMBERS = 12  # classes of a group
TOP, CLIP = 60.0, 8.0  # bounds of attention logits and of the hidden layer


def words_of(body: bytes) -> list[bytes]:
    """A-Z lowered; runs of anything but space and \\x09-\\x0D."""
    return body.lower().split()


def _coded_words(bodies: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """``words_of`` each text in a row, dictionary-encoded, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(bodies.cast(pa.string())))
    count = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    if pc.all(real).as_py() is False:
        owner = np.repeat(np.arange(len(count)), count)
        words, count = words.filter(real), np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(count))
    return words.dictionary_encode(), count


def subwords(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, sizes)`` of words, each with a space before it."""
    encode = encoder(path).encode_ordinary
    lists = [encode(" " + w.decode()) for w in words]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.int32, int(size.sum())), size


@functools.lru_cache(maxsize=2)
def begins_word(path: str) -> np.ndarray:
    """For every id whether its bytes begin with a space; true for END."""
    enc = encoder(path)
    out = np.array([enc.decode_single_token_bytes(i)[:1] == b" " if i < enc.n_vocab and i != END else True for i in range(IDS)])
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each of several runs."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32, compressed with their low bytes together, then the higher ones."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _squeeze(raw) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


# --- slices -------------------------------------------------------------------

_SLICE = (
    "slice long, doc_id array<long>, held array<boolean>, n_words array<long>, codes binary, ids binary, id_sizes binary, n_distinct long, n_ids long, "
    "per_bucket array<long>, words binary, word_sizes binary, word_bytes long, trained binary"
)


def _slice_row(batch: pa.RecordBatch, name: int, buckets: int, path: str) -> pa.RecordBatch:
    """One row for the texts of ``batch``; distinct words are numbered by bucket."""
    held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
    coded, count = _coded_words(batch.column(2))
    distinct = coded.dictionary.cast(pa.binary())
    listed = distinct.to_pylist()
    bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in listed), np.int64, len(listed))
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    code = number[coded.indices.to_numpy()] if len(order) else np.empty(0, np.int64)
    listed = [listed[i] for i in order.tolist()]
    ids, size = subwords(listed, path)
    trained = np.bincount(code[~np.repeat(held, count)], minlength=len(listed))
    joined = b"".join(listed)
    row = {
        "slice": name, "doc_id": batch.column(0).to_pylist(), "held": held.tolist(), "n_words": count.tolist(), "codes": _pack(code), "ids": _squeeze(ids.astype("<u2")),
        "id_sizes": _pack(size), "n_distinct": len(listed), "n_ids": len(ids), "per_bucket": np.bincount(bucket, minlength=buckets).tolist(), "words": _squeeze(joined),
        "word_sizes": _pack(np.fromiter(map(len, listed), np.int64, len(listed))), "word_bytes": len(joined), "trained": _pack(trained),
    }
    return pa.RecordBatch.from_pylist([row], schema=_arrow(_SLICE))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    of = lambda k: pa.list_(kinds[k[6:-1]]) if k.startswith("array<") else kinds[k]
    return pa.schema([(n, of(k)) for n, k in (c.split() for c in ddl.split(", "))])


def code_texts(docs: DataFrame, id_col: str, text_col: str, held_out: int | None, path: str, slice_bytes: int) -> DataFrame:
    """The texts as a written table of slices, see ``_SLICE``."""
    held = is_held_out(id_col, held_out) if held_out else F.lit(False)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), utf8(text_col).alias("body"))
    buckets = shuffle_partitions(docs.sparkSession)

    def cut(batches):
        at = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, 2, slice_bytes):
                yield _slice_row(batch, at, buckets, path)
                at += 1

    return materialize(rows.mapInArrow(cut, _SLICE), "lm-slices")


class _Slice:
    """A decoded row: words of texts as codes, and the distinct words' ids."""

    def __init__(self, row: dict, only_training: bool = False):
        n_words = np.array(row["n_words"], np.int64)
        self.code = _unpack(row["codes"], int(n_words.sum()))
        if only_training:
            keep = ~np.array(row["held"], bool)
            self.code, n_words = self.code[np.repeat(keep, n_words)], n_words[keep]
        self.n_words = n_words
        self.ids = np.frombuffer(pa.decompress(row["ids"], 2 * row["n_ids"], codec="zstd"), "<u2").astype(np.int32)
        self.size = _unpack(row["id_sizes"], row["n_distinct"])
        self.start = np.cumsum(self.size) - self.size

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids with END after each text, where texts start, and ids of each word."""
        n_ids = self.size[self.code]
        first = np.concatenate(([0], np.cumsum(self.n_words)))
        before = np.concatenate(([0], np.cumsum(n_ids)))
        n = len(self.n_words)
        stream = np.full(int(before[-1]) + n, END, np.int32)
        own = np.ones(len(stream), bool)
        own[before[first[1:]] + np.arange(n)] = False
        stream[own] = self.ids[_spread(self.start[self.code], n_ids)]
        return stream, before[first[:-1]] + np.arange(n), n_ids


_TEXT = ["n_words", "held", "codes", "ids", "id_sizes", "n_distinct", "n_ids"]


# --- sums over tasks ------------------------------------------------------------


def summed(slices_: DataFrame, columns: list[str], work: Callable[[Iterator[dict]], np.ndarray], size: int, tag: str) -> np.ndarray:
    """The sum of ``work``'s vectors of ``size`` over all tasks; a tree keeps what the driver gets to 32 of them."""

    def per_task(batches):
        got = work(row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([_squeeze(np.ascontiguousarray(got, "<f8"))], pa.binary())], names=["v"])

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(pa.decompress(v.as_buffer(), 8 * size, codec="zstd"), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([_squeeze(total)], pa.binary())], names=["v"])

    parts = materialize(slices_.select(*columns).mapInArrow(per_task, "v binary"), tag)
    while (n := parts.count()) > 32:
        parts = materialize(parts.repartition(-(-n // 16)).mapInArrow(add, "v binary"), tag)
    total = np.zeros(size)
    for r in parts.toLocalIterator():
        total += np.frombuffer(pa.decompress(bytes(r["v"]), 8 * size, codec="zstd"), "<f8")
    return total


def id_counts(slices_: DataFrame) -> np.ndarray:
    """How often training texts have each id, END included."""

    def work(rows):
        total = np.zeros(IDS)
        for row in rows:
            own = _Slice(row, only_training=True)
            times = np.bincount(own.code, minlength=len(own.size))
            total += np.bincount(own.ids, np.repeat(times, own.size), IDS)
            total[END] += len(own.n_words)
        return total

    return summed(slices_, _TEXT, work, IDS, "lm-ids")


class Classes:
    """Classes of ids and their groups, and P(id | class, class before).

    Ids of either kind are ordered by frequency and cut where the running sum
    of the roots of their counts passes equal shares.
    """

    def __init__(self, counts: np.ndarray, begins: np.ndarray, groups: int = 12, known: int = 3000):
        self.of = np.zeros(IDS, np.int64)
        root, at = np.sqrt(counts + 0.01), 0
        used: list[int] = []
        kinds = (np.flatnonzero(begins), np.flatnonzero(~begins))
        share = [min(groups - 1, max(1, round(groups * root[kind].sum() / root.sum()))) for kind in kinds]
        for kind, n in zip(kinds, (share[0], groups - share[0])):
            kind = kind[np.argsort(-counts[kind], kind="stable")]
            cut = np.cumsum(root[kind]) - root[kind]
            numbers = np.unique((cut * (n * MEMBERS) / root[kind].sum()).astype(np.int64).clip(0, n * MEMBERS - 1), return_inverse=True)[1]
            self.of[kind] = at + numbers
            used += range(at, at + int(numbers.max()) + 1)
            at += -(-(int(numbers.max()) + 1) // MEMBERS) * MEMBERS
            if kind[0] == END or begins[kind[0]]:
                self.begin_groups = at // MEMBERS
        self.groups, self.n = at // MEMBERS, at
        self.exists = np.isin(np.arange(at), used)
        often = np.argsort(-counts, kind="stable")[:known]
        often = np.union1d(often[counts[often] > 4], [END])
        self.embed = len(often) + self.of
        self.embed[often] = np.arange(len(often))
        self.n_embed = len(often) + at
        self.share: np.ndarray | None = None

    def learn_shares(self, pairs: np.ndarray, counts: np.ndarray, strength: float = 20.0) -> None:
        """From ``pairs`` (class before, id) and plain ``counts``; every id keeps some probability."""
        plain = (counts + 0.5) / np.bincount(self.of, counts + 0.5, self.n)[self.of]
        pairs = pairs.reshape(self.n, IDS)
        self.share = np.empty((self.n, IDS), np.float32)
        for before in range(self.n):
            total = np.bincount(self.of, pairs[before], self.n)[self.of]
            self.share[before] = np.log((pairs[before] + strength * plain) / (total + strength))


def pair_counts(slices_: DataFrame, classes: Classes) -> np.ndarray:
    """How often an id follows a class in training texts, flat by (class, id)."""
    of = classes.of
    size = classes.n * IDS

    def work(rows):
        total = np.zeros(size)
        for row in rows:
            stream, starts, _ = _Slice(row, only_training=True).stream()
            before = np.concatenate(([END], stream[:-1])) if len(stream) else stream
            total += np.bincount(of[before] * IDS + stream, minlength=size)
        return total

    return summed(slices_, _TEXT, work, size, "lm-pairs")


# --- the network ----------------------------------------------------------------


def blocks_of(stream: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(x, y, at)``: ids before and at each position in rows of BLOCK, and where the stream's ids went.

    Each text begins a row, after a row of END; positions beyond a text hold -1 in ``y``.
    """
    size = np.diff(np.append(starts, len(stream)))
    rows = -(-size // BLOCK)
    first = np.cumsum(rows + 1) - rows
    at = _spread(first * BLOCK, size)
    total = int((rows + 1).sum())
    x, y = np.full(total * BLOCK, END, np.int32), np.full(total * BLOCK, -1, np.int32)
    x[at] = np.concatenate(([END], stream[:-1])) if len(stream) else stream
    y[at] = stream
    return x.reshape(total, BLOCK), y.reshape(total, BLOCK), at


class AttentionModel:
    """One layer of causal self-attention that predicts the next id's group, and its class within each group."""

    def __init__(self, classes: Classes, width: int = 16, key: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        w, n = 1 / np.sqrt(width), classes.n
        p = {
            "e": rng.normal(0, 0.5, (classes.n_embed, width)), "q": rng.normal(0, w, (width, key)), "k": rng.normal(0, w, (width, key)),
            "v": rng.normal(0, w, (width, width)), "rel": np.zeros(2 * BLOCK), "w1": rng.normal(0, w, (width, width)), "b1": np.zeros(width),
            "wg": rng.normal(0, w, (width, classes.groups)), "bg": np.zeros(classes.groups), "wc": rng.normal(0, w, (width, n)), "bc": np.zeros(n),
        }
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.p["b1"] += np.float32(0.5)
        self.distance = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]  # from a key back to its query
        self.causal = self.distance >= 0

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_vector(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(v.dtype)
            at += v.size

    def _bias(self) -> np.ndarray:
        rel = self.p["rel"][np.clip(self.distance, 0, 2 * BLOCK - 1)]
        return np.where(self.causal, rel, np.float32(-1e9)).astype(rel.dtype)

    @staticmethod
    def _windows(rows: np.ndarray) -> np.ndarray:
        """Each row of (..., n + 1, BLOCK, d) with the one before it: (..., n, 2 BLOCK, d), a view."""
        *lead, n, _, d = rows.shape
        return np.lib.stride_tricks.as_strided(rows, (*lead, n - 1, 2 * BLOCK, d), rows.strides)

    @staticmethod
    def _by_group(group: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order that brings positions of a group together, and ``(group, from, to)`` of each."""
        order = np.argsort(group.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=groups)).tolist()
        return order, [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]

    def _class_bias(self) -> np.ndarray:
        return np.where(self.classes.exists, self.p["bc"], -1e9).astype(self.p["bc"].dtype)

    def gradients(self, x: np.ndarray, y: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the classes of ids ``y`` (r, n, BLOCK) after ``x`` (r, n + 1, BLOCK), and its gradients."""
        p, c = self.p, self.classes
        kind = p["q"].dtype.type
        width, key = p["v"].shape[0], p["q"].shape[1]
        scale = kind(1 / np.sqrt(key))
        rows = c.embed[x]
        e = p["e"].take(rows, axis=0)
        own = e[:, 1:]
        flat, flat_own = e.reshape(-1, width), own.reshape(-1, width)
        q = (flat_own @ (p["q"] * scale)).reshape(*own.shape[:-1], key)
        k, v = (flat @ p["k"]).reshape(*e.shape[:-1], key), (flat @ p["v"]).reshape(e.shape)
        k2, v2 = self._windows(k), self._windows(v)
        s = q @ k2.swapaxes(-1, -2)
        s += self._bias()
        np.minimum(s, kind(TOP), out=s)
        free = s < TOP
        np.exp(s, out=s)
        s /= (s.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, kind)).reshape(*s.shape[:-1], 1)
        h = (s @ v2 + own).reshape(-1, width)
        u = h @ p["w1"]
        u += p["b1"]
        np.clip(u, 0, CLIP, out=u)
        target = c.of[y.ravel()]
        real = y.ravel() >= 0
        n, at = max(real.sum(), 1), np.arange(len(target))
        group, member = np.divmod(target, MEMBERS)
        weight = (real / n).astype(kind)[:, None]
        lg = u @ p["wg"]
        lg += p["bg"]
        np.exp(lg, out=lg)
        lg /= (lg @ np.ones(c.groups, kind))[:, None]
        at_group = at * c.groups + group
        loss = -np.log(lg.ravel()[at_group[real]] + 1e-12).sum() if with_loss else 0.0
        lg.ravel()[at_group] -= 1
        lg *= weight
        g = {"wg": u.T @ lg, "bg": lg.sum(0), "wc": np.zeros_like(p["wc"]), "bc": np.zeros_like(p["bc"])}
        du = lg @ p["wg"].T
        # classes within a group: positions of one group at a time
        order, parts = self._by_group(group, c.groups)
        us, at_member, bias = u.take(order, axis=0), at * MEMBERS + member.take(order), self._class_bias()
        lc, dus = np.empty((len(us), MEMBERS), kind), np.empty_like(us)
        columns = [(slice(a, b), slice(which * MEMBERS, (which + 1) * MEMBERS)) for which, a, b in parts]
        for some, cols in columns:
            np.matmul(us[some], p["wc"][:, cols], out=lc[some])
            lc[some] += bias[cols]
        np.exp(lc, out=lc)
        lc /= (lc @ np.ones(MEMBERS, kind))[:, None]
        if with_loss:
            loss -= np.log(lc.ravel()[at_member[real[order]]] + 1e-12).sum()
        lc.ravel()[at_member] -= 1
        lc *= weight.take(order, axis=0)
        for some, cols in columns:
            g["wc"][:, cols], g["bc"][cols] = us[some].T @ lc[some], lc[some].sum(0)
            np.matmul(lc[some], p["wc"][:, cols].T, out=dus[some])
        du[order] += dus
        du *= (u > 0) & (u < CLIP)
        g |= {"w1": h.T @ du, "b1": du.sum(0)}
        dh = (du @ p["w1"].T).reshape(own.shape)
        ds, dv2 = dh @ v2.swapaxes(-1, -2), s.swapaxes(-1, -2) @ dh
        ds *= s
        s *= (ds.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, kind)).reshape(*s.shape[:-1], 1)
        ds -= s
        ds *= free
        g["rel"] = np.bincount(np.clip(self.distance, 0, 2 * BLOCK - 1).ravel(), (ds.sum((0, 1)) * self.causal).ravel(), 2 * BLOCK)
        dq, dk2 = ds @ k2, ds.swapaxes(-1, -2) @ q
        dk, dv = np.zeros_like(k), np.zeros_like(v)
        for whole, halves in ((dk, dk2), (dv, dv2)):
            whole[:, :-1] += halves[:, :, :BLOCK]
            whole[:, 1:] += halves[:, :, BLOCK:]
        dq, dk, dv = dq.reshape(-1, key), dk.reshape(-1, key), dv.reshape(-1, width)
        g |= {"q": flat_own.T @ dq * scale, "k": flat.T @ dk, "v": flat.T @ dv}
        de = (dk @ p["k"].T + dv @ p["v"].T).reshape(e.shape)
        de[:, 1:] += dh + (dq @ (p["q"].T * scale)).reshape(own.shape)
        where = (rows.reshape(-1, 1) * width + np.arange(width)).ravel()
        g["e"] = np.bincount(where, de.ravel(), p["e"].size).reshape(p["e"].shape)
        return float(loss / n), g

    def log_probs(self, stream: np.ndarray, starts: np.ndarray, rows_at_once: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs, for every id of texts that begin at ``starts`` and end with END, of
        P(id | ids before) and of the probability that an id that begins a word stands there."""
        p, c = self.p, self.classes
        x, y, at = blocks_of(stream, starts)
        total = len(x)
        key, width = p["q"].shape[1], p["e"].shape[1]
        queries, keys, values = p["e"] @ p["q"] * np.float32(1 / np.sqrt(key)), p["e"] @ p["k"], p["e"] @ p["v"]
        bias, bc = self._bias(), self._class_bias()
        ones = {m: np.ones(m, np.float32) for m in (2 * BLOCK, c.groups, MEMBERS, c.begin_groups)}
        target, rows = c.of.astype(np.int16)[y], c.embed.astype(np.int32)[x]
        group_of, member_of = np.divmod(target, MEMBERS)
        out, begin = np.zeros((total, BLOCK), np.float32), np.zeros((total, BLOCK), np.float32)
        each = np.arange(rows_at_once * BLOCK)
        for lo in range(1, total, rows_at_once):
            hi = min(total, lo + rows_at_once)
            n = (hi - lo) * BLOCK
            k2, v2 = self._windows(keys.take(rows[lo - 1 : hi], axis=0)), self._windows(values.take(rows[lo - 1 : hi], axis=0))
            own = rows[lo:hi]
            s = queries.take(own, axis=0) @ k2.swapaxes(-1, -2)
            s += bias
            np.minimum(s, np.float32(TOP), out=s)
            np.exp(s, out=s)
            h = (s @ v2).reshape(n, width)
            h /= (s.reshape(n, 2 * BLOCK) @ ones[2 * BLOCK])[:, None]
            h += p["e"].take(own.ravel(), axis=0)
            u = h @ p["w1"]
            u += p["b1"]
            np.clip(u, 0, CLIP, out=u)
            lg = u @ p["wg"]
            lg += p["bg"]
            group, member = group_of[lo:hi].ravel(), member_of[lo:hi].ravel()
            got = lg.ravel().take(each[:n] * c.groups + group)
            np.exp(lg, out=lg)
            log_all = np.log(lg @ ones[c.groups])
            begin[lo:hi] = (np.log(lg[:, : c.begin_groups] @ ones[c.begin_groups]) - log_all).reshape(hi - lo, BLOCK)
            got -= log_all
            order, parts = self._by_group(group, c.groups)
            us = u.take(order, axis=0)
            lc = np.empty((n, MEMBERS), np.float32)
            for which, a, b in parts:
                cols = slice(which * MEMBERS, (which + 1) * MEMBERS)
                np.matmul(us[a:b], p["wc"][:, cols], out=lc[a:b])
                lc[a:b] += bc[cols]
            of_class = lc.ravel().take(each[:n] * MEMBERS + member.take(order))
            np.exp(lc, out=lc)
            of_class -= np.log(lc @ ones[MEMBERS])
            got[order] += of_class
            out[lo:hi] = got.reshape(hi - lo, BLOCK)
        before = np.concatenate(([END], stream[:-1])) if len(stream) else stream
        return out.ravel()[at].astype(float) + c.share.ravel().take(c.of[before] * IDS + stream), begin.ravel()[at].astype(float)


def follow(model: AttentionModel, stream: np.ndarray, starts: np.ndarray, seed: int, runs: int = 8, rows: int = 32, rate: float = 0.03) -> int:
    """Adam over runs of neighbouring rows of the texts in random order, each run once; the steps made."""
    x, y, _ = blocks_of(stream, starts)
    if not len(x):
        return 0
    pad = -(len(x) - 1) % rows
    x = np.concatenate((x, np.full((pad, BLOCK), END, np.int32)))
    y = np.concatenate((y, np.full((pad, BLOCK), -1, np.int32)))
    rng = np.random.default_rng(seed)
    first = rng.permutation(np.arange(0, len(x) - 1, rows))
    steps = -(-len(first) // runs)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        some = first[(step - 1) * runs : step * runs, None]
        _, grads = model.gradients(x[some + np.arange(rows + 1)], y[some + np.arange(1, rows + 1)], with_loss=False)
        now = rate * (1 - 0.95 * step / steps)
        for k, g in grads.items():
            m, v = moments[k]
            m += np.float32(0.1) * (g - m).astype(np.float32)
            v += np.float32(0.01) * (g * g - v).astype(np.float32)
            model.p[k] -= np.float32(now / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return steps


#: Slices are dealt to sixteen parts; round by round so many of them are followed.
ROUNDS = ((0, 4), (4, 16))


def fit(slices_: DataFrame, path: str, seed: int = 7, **how) -> AttentionModel:
    """Learn from the training texts of all slices.

    A first round follows one slice, so that all others start near each other.
    Then each round's tasks start from the average of the round before,
    weighted by steps. A round without slices changes nothing.
    """
    spark = slices_.sparkSession
    counts = id_counts(slices_)
    classes = Classes(counts, begins_word(path))
    model = AttentionModel(classes, seed=seed)
    size = len(model.vector())
    part = F.pmod(F.xxhash64("slice"), F.lit(16))
    least = slices_.agg(F.min_by("slice", F.xxhash64("slice"))).first()[0]
    rounds = [slices_.filter(F.col("slice").eqNullSafe(F.lit(least))), *(slices_.filter((part >= low) & (part < high)) for low, high in ROUNDS)]
    for turn, followed in enumerate(rounds):
        start = spark.sparkContext.broadcast(model)

        def work(rows, start=start, turn=turn):
            total = np.zeros(size + 1)
            own = None
            for row in rows:
                if own is None:
                    own = AttentionModel(start.value.classes, seed=seed)
                    own.set_vector(start.value.vector())
                stream, starts, _ = _Slice(row, only_training=True).stream()
                total[-1] += follow(own, stream, starts, row["slice"] % (1 << 31) + turn, **how)
            if own is not None:
                total[:-1] = own.vector() * total[-1]
            return total

        got = summed(followed, [*_TEXT, "slice"], work, size + 1, "lm-round")
        if got[-1]:
            model.set_vector(got[:-1] / got[-1])
    classes.learn_shares(pair_counts(slices_, classes), counts)
    return model


# --- words --------------------------------------------------------------------


def word_counts(slices_: DataFrame) -> DataFrame:
    """``(slice, bucket, counts, n, n_distinct, tokens, known)``, a written table.

    A row answers a slice's list of a bucket with the words' training counts;
    rows without slice have the bucket's training tokens and known words.
    """

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                size, trained = _unpack(row["word_sizes"], row["n_distinct"]), _unpack(row["trained"], row["n_distinct"])
                words = pa.decompress(row["words"], row["word_bytes"], codec="zstd", asbytes=True)
                end = np.cumsum(size)
                at = 0
                out = []
                for bucket, n in enumerate(row["per_bucket"]):
                    if n:
                        lo, hi = int(end[at] - size[at]), int(end[at + n - 1])
                        out.append((row["slice"], bucket, n, hi - lo, _squeeze(words[lo:hi]), _pack(size[at : at + n]), _pack(trained[at : at + n])))
                        at += n
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    names = ["slice", "bucket", "n", "bytes", "words", "sizes", "trained"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def answer(asked: pa.Table) -> pa.Table:
        sizes, trained, data, names, ns = [], [], [], [], []
        for batch in asked.to_batches():
            for row in batch.to_pylist():
                sizes.append(_unpack(row["sizes"], row["n"]))
                trained.append(_unpack(row["trained"], row["n"]))
                data.append(pa.decompress(row["words"], row["bytes"], codec="zstd", asbytes=True))
                names.append(row["slice"])
                ns.append(row["n"])
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))])
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        count = np.bincount(code, np.concatenate(trained), len(coded.dictionary)).astype(np.int64)
        own, at = count[code], np.concatenate(([0], np.cumsum(ns)))
        # counts beyond 32 bits are kept in two halves
        low, high = own & 0xFFFFFFFF, own >> 32
        packed = [(_pack(low[a:b]), _pack(high[a:b])) for a, b in zip(at.tolist(), at[1:].tolist())]
        bucket = asked["bucket"][0].as_py()
        return pa.table({
            "slice": pa.array([*names, None], pa.int64()), "bucket": pa.array([bucket] * (len(ns) + 1), pa.int32()), "low": pa.array([*(a for a, _ in packed), None], pa.binary()),
            "high": pa.array([*(b for _, b in packed), None], pa.binary()), "n": pa.array([*ns, 0], pa.int64()),
            "tokens": pa.array([0] * len(ns) + [int(count.sum())], pa.int64()), "known": pa.array([0] * len(ns) + [int((count > 0).sum())], pa.int64()),
        })

    asked = slices_.select("slice", "n_distinct", "per_bucket", "words", "word_sizes", "word_bytes", "trained").mapInArrow(
        ask, "slice long, bucket int, n long, bytes long, words binary, sizes binary, trained binary"
    )
    answered = asked.groupBy("bucket").applyInArrow(answer, "slice long, bucket int, low binary, high binary, n long, tokens long, known long")
    return materialize(answered, "lm-words")


def mixed_scores(word: np.ndarray, chain: np.ndarray, mix: float) -> np.ndarray:
    """Natural log of ``mix`` times the words' shares and the rest of their probabilities as ids; ``word`` are shares, ``chain`` logs."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(mix * word), np.log1p(-mix) + chain) if mix < 1 else np.log(word)


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int | None = 7, vocabulary: str | None = None, slice_bytes: int = 8 << 20, mix: float = 0.25, **how
) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score.

    ``held_out`` leaves ids whose remainder of that modulus is 2 out of all
    learning. Scores are log10 probabilities; over all texts each sums to no
    more than 1. Defined results: null and empty texts are their end alone;
    repeated rows are counted and returned each; null ids are learned from;
    without any training text ``score`` is the untrained network's, and an
    empty table gives an empty result; other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    sliced = code_texts(docs, id_col, text_col, held_out, path, slice_bytes)
    return score_slices(sliced, fit(sliced, path, **how), mix)


def score_slices(sliced: DataFrame, model: AttentionModel, mix: float = 0.25) -> DataFrame:
    """The result of ``score_texts`` for coded texts."""
    shared = sliced.sparkSession.sparkContext.broadcast(model)
    counted = word_counts(sliced)
    n_words, v_words = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    trained = F.size(F.filter("held", lambda h: ~h))
    ends = sliced.agg(F.coalesce(F.sum(trained), F.lit(0))).first()[0]
    n_all, v_all = n_words + ends, v_words + (ends > 0)
    base = np.log10(n_all + v_all + 1)  # the smoothed denominator, N + 1 * (V + 1)
    share = mix if n_all else 0.0

    def finish(texts: pa.Table, words: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        own = _Slice(row)
        found = sorted(words.select(["bucket", "n", "low", "high"]).to_pylist(), key=lambda r: r["bucket"])
        c = np.concatenate([np.empty(0, np.int64), *(_unpack(r["low"], r["n"]) + (_unpack(r["high"], r["n"]) << 32) for r in found)])
        stream, starts, n_ids = own.stream()
        lp, begin = shared.value.log_probs(stream, starts)
        n, code = own.n_words, own.code
        doc = np.repeat(np.arange(len(n)), n)
        # places of words and ends in the stream: each is followed by the next one's first id
        size = np.ones(len(code) + len(n), np.int64)
        is_end = np.zeros(len(size), bool)
        is_end[np.cumsum(n + 1) - 1] = True
        size[~is_end] = n_ids
        first = np.cumsum(size) - size
        chain = np.add.reduceat(lp, first) - begin[first]
        chain[~is_end] += begin[(first + size)[~is_end]]
        shares = np.empty(len(size))
        shares[~is_end], shares[is_end] = c[code], ends
        mixed = mixed_scores(shares / max(n_all, 1), chain, share) / np.log(10)
        owner = np.repeat(np.arange(len(n)), n + 1)
        end = np.log10(ends + 1.0) - base
        base_score = np.bincount(doc, np.log10(c + 1.0)[code] - base, len(n)) + end if len(code) else np.full(len(n), end)
        n_known = np.bincount(doc, (c > 0)[code], len(n)).astype(np.int64) + (ends > 0) if len(code) else np.full(len(n), int(ends > 0))
        return pa.table({
            "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(n + 1), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(n), n_all, np.int64)), "base_score": pa.array(base_score), "score": pa.array(np.bincount(owner, mixed, len(n))),
            "attention_score": pa.array(np.bincount(owner, chain / np.log(10), len(n))),
        })

    texts = sliced.select("slice", "doc_id", *_TEXT)
    answers = counted.filter("slice IS NOT NULL").select(F.col("slice").alias("of_slice"), "bucket", "n", "low", "high")
    return texts.groupBy("slice").cogroup(answers.groupBy("of_slice")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, attention_score double"
    )
