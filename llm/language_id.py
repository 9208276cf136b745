"""Operator 4, language identification: a bidirectional GRU over bytes.

The network labels every byte position of a text with language probabilities,
and a document's probabilities are the mean over its positions. A text is read
as its space-separated words in lower case, each with the space before it; the
state starts anew at each, so a word's labels are the same wherever it occurs
and each distinct word of a batch is run once. Training is backpropagation
through time in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out
from .subwords import slices

#: Longer words are cut into windows of so many bytes, the space included.
WINDOW = 32


class BiGru:
    """Two GRUs, one in each direction, and a softmax on both states.

    Each direction has ``x`` (256, 3H), ``u`` (H, 3H) and ``b`` (3H), for the
    update, reset and new gates; ``out`` is (2H, languages) with ``bias``.
    """

    def __init__(self, languages: int, hidden: int = 8, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        p = {}
        for d in ("f", "b"):
            p[f"{d}x"] = rng.normal(0, 0.3, (256, 3 * hidden))
            p[f"{d}u"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            p[f"{d}b"] = np.zeros(3 * hidden)
        p["out"], p["bias"] = rng.normal(0, 0.3, (2 * hidden, languages)), np.zeros(languages)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _run(self, d: str, bytes_: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte of (n, T) bytes: (T, n, H)."""
        h_size, (x, u, b) = self.hidden, (self.p[d + k] for k in "xub")
        n, length = bytes_.shape
        h = np.zeros((n, h_size), x.dtype)
        states = np.empty((length, n, h_size), x.dtype)
        x = x + b
        for t in range(length):
            gates, back = x[bytes_[:, t]], h @ u
            zr = gates[:, : 2 * h_size]
            zr += back[:, : 2 * h_size]
            zr *= 0.5  # a sigmoid is half a tanh of the half, raised
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :h_size], zr[:, h_size:]
            new = r * back[:, 2 * h_size :]
            new += gates[:, 2 * h_size :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((h, z, r, new, back[:, 2 * h_size :]))
            h = np.subtract(h, new, out=states[t])
            h *= z
            h += new
        return states

    def positions(self, bytes_: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (T, n, languages); positions at or after a length are meaningless."""
        length = bytes_.shape[1]
        back_at = np.clip(lengths[None, :] - 1 - np.arange(length)[:, None], 0, length - 1)  # (T, n)
        rows = np.arange(len(bytes_))
        mirrored = bytes_[rows[:, None], back_at.T]
        f = self._run("f", bytes_, None if keep is None else keep.setdefault("f", []))
        b = self._run("b", mirrored, None if keep is None else keep.setdefault("b", []))
        both = np.concatenate((f, b[back_at, rows[None, :]]), axis=2)
        logits = both @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        if keep is not None:
            keep |= {"both": both, "back_at": back_at, "mirrored": mirrored}
        return e / e.sum(2, keepdims=True)

    def summed(self, bytes_: np.ndarray) -> np.ndarray:
        """Probabilities summed over the positions of (n, T) bytes that are whole words."""
        f, b = self._run("f", bytes_), self._run("b", bytes_[:, ::-1])
        h_size, out = self.hidden, np.zeros((len(bytes_), len(self.p["bias"])), np.float32)
        for t in range(bytes_.shape[1]):
            e = f[t] @ self.p["out"][:h_size]
            e += b[-1 - t] @ self.p["out"][h_size:]
            e += self.p["bias"]
            np.exp(e, out=e)  # states are within (-1, 1), so logits are small
            e /= e.sum(1, keepdims=True)
            out += e
        return out

    def gradients(self, bytes_: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy per position, every position labelled as its word, and its gradients."""
        keep: dict = {}
        p = self.positions(bytes_, lengths, keep)
        length, n, _ = p.shape
        valid = np.arange(length)[:, None] < lengths[None, :]
        total, rows = valid.sum(), np.arange(n)
        loss = -(np.log(p[:, rows, labels] + 1e-12) * valid).sum() / total
        d = p.copy()
        d[:, rows, labels] -= 1
        d *= valid[:, :, None] / total
        both, h_size = keep["both"], self.hidden
        g = {"out": np.einsum("tnh,tnl->hl", both, d), "bias": d.sum((0, 1))}
        d_both = d @ self.p["out"].T
        d_back = np.zeros_like(d_both[:, :, h_size:])
        t_at, n_at = np.nonzero(valid)
        d_back[keep["back_at"][t_at, n_at], n_at] = d_both[t_at, n_at, h_size:]
        for way, d_states, seen in (("f", d_both[:, :, :h_size], bytes_), ("b", d_back, keep["mirrored"])):
            u = self.p[way + "u"]
            gx, gu, gb = np.zeros_like(self.p[way + "x"]), np.zeros_like(u), np.zeros(3 * h_size, u.dtype)
            dh = np.zeros((n, h_size), u.dtype)
            for t in range(length - 1, -1, -1):
                h, z, r, new, back = keep[way][t]
                dh = dh + d_states[t]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                d_gates = np.concatenate((d_z, d_r, d_new), axis=1)
                d_rec = np.concatenate((d_z, d_r, d_new * r), axis=1)
                np.add.at(gx, seen[:, t], d_gates)
                gb += d_gates.sum(0)
                gu += h.T @ d_rec
                dh = dh * z + d_rec @ u.T
            g |= {way + "x": gx, way + "u": gu, way + "b": gb}
        return float(loss), g


class Identifier:
    """A trained network and the languages it tells apart."""

    def __init__(self, net: BiGru, languages: list[str]):
        self.net, self.languages = net, languages

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Summed position probabilities of each word, (n, languages)."""
        piece_of, pieces = [], []
        for i, w in enumerate(words):
            for at in range(0, len(w), WINDOW):
                piece_of.append(i)
                pieces.append(w[at : at + WINDOW])
        sums = np.zeros((len(pieces), len(self.languages)), np.float32)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(size, kind="stable")
        owner = np.array(piece_of, np.int64)
        for length in np.unique(size).tolist():
            own = order[np.searchsorted(size[order], length) : np.searchsorted(size[order], length, "right")]
            for lo in range(0, len(own), 4096):
                some = own[lo : lo + 4096]
                bytes_ = np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), np.uint8).reshape(len(some), length)
                sums[some] = self.net.summed(bytes_)
        # pieces of a word follow each other, and every word has some
        return np.add.reduceat(sums, np.searchsorted(owner, np.arange(len(words))), axis=0) if len(words) else sums

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Mean position probabilities of each text, (n, languages); zeros for empty ones."""
        split = pc.split_pattern(pc.utf8_lower(pc.fill_null(texts, "")), " ")
        count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = [b" " + w for w in coded.dictionary.cast(pa.binary()).to_pylist()]
        sums, size = self.word_sums(words), np.fromiter(map(len, words), np.int64, len(words))
        code = coded.indices.to_numpy()
        if not len(code):
            return np.zeros((len(texts), len(self.languages)))
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        per_text = np.add.reduceat(sums[code], first, axis=0).astype(float)
        return per_text / np.add.reduceat(size[code], first)[:, None]


def train(words: list[bytes], labels: np.ndarray, languages: list[str], steps: int = 300, batch: int = 512, rate: float = 0.01, seed: int = 4) -> Identifier:
    """Adam on random batches of words, each labelled as its document."""
    net = BiGru(max(len(languages), 1), seed=seed)
    if len(words) and len(languages) > 1:
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        pieces = [w[:WINDOW] for w in words]  # longer words are cut into windows when texts are read, too
        groups = [np.flatnonzero(labels == k) for k in range(len(languages))]
        for step in range(1, steps + 1):
            some = np.concatenate([g[rng.integers(len(g), size=max(1, batch // len(languages)))] for g in groups if len(g)])
            size = np.array([len(pieces[i]) for i in some])
            bytes_ = np.zeros((len(some), size.max()), np.uint8)
            for row, i in enumerate(some):
                bytes_[row, : size[row]] = np.frombuffer(pieces[i], np.uint8)
            _, grads = net.gradients(bytes_, size, labels[some])
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Identifier(net, languages)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_language: int = 300, words_per_document: int = 200,
    held_out: int | None = 4, **how,
) -> Identifier:
    """Train on at most ``max_per_language`` labelled documents of each language.

    They are those with the smallest hashes of their ids; of each, at most
    ``words_per_document`` words spread evenly over the whole text. ``held_out``
    leaves out ids whose remainder of that modulus is 2.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL")
    if held_out:
        rows = rows.filter(~is_held_out("_id", held_out))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    picked = None
    for lang in languages:
        some = rows.filter(F.col("lang") == lang).orderBy(F.xxhash64("_id"), "_id").limit(max_per_language)
        picked = some if picked is None else picked.union(some)
    if picked is None:
        return train([], np.empty(0, np.int64), [])

    def words(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                w = text.lower().split(" ")
                places = np.linspace(0, len(w) - 1, min(len(w), words_per_document)).astype(int)
                out.append([b" " + w[i].encode() for i in places if w[i]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.binary())), batch.column(2)], names=["id", "words", "lang"])

    # the ids are bounded by the languages, so every task may have them all
    sample = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    sample = sample.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select(F.col("_id").cast("long"), "text", "lang")
    got = sorted(sample.mapInArrow(words, "id long, words array<binary>, lang string").collect(), key=lambda r: r["id"])
    flat = [bytes(w) for r in got for w in r["words"]]
    labels = np.array([languages.index(r["lang"]) for r in got for _ in r["words"]], np.int64)
    return train(flat, labels, languages, **how)


def identify(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text.

    Defined results: null texts and texts without a letter are ``und`` with
    score 0, as is everything when no language was learned; equal texts get equal results;
    of tied languages the first in order wins; repeated rows are returned each;
    null ids are kept; an empty table gives an empty result; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found = shared.value
        names = np.array([*found.languages, "und"], object)
        for whole in batches:
            for batch in slices(whole, 1, 32 << 20):  # more words of a larger slice are copies
                texts = batch.column(1)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                p = found.probabilities(texts)
                best = np.where(letters & (len(found.languages) > 0), p.argmax(1) if p.shape[1] else 0, len(found.languages))
                score = np.where(best < len(found.languages), p.max(1) if p.shape[1] else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1).astype(float))], names=["doc_id", "lang_pred", "score"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
