"""Plain, slow versions of the operators, for small inputs. No Spark."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def exact_groups(docs: list[tuple[int, str | None]]) -> list[tuple]:
    by_text = defaultdict(list)
    for i, t in docs:
        by_text[lowered(t)].append(i)
    out = []
    for i, t in docs:
        key = lowered(t)
        keep = max(by_text[key])
        out.append((i, keep, len(by_text[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out)


def warc(pages: list[tuple[int, str | None]]) -> list[tuple]:
    first: dict[bytes, int] = {}
    for i, html in pages:
        p = (html or "").encode()
        first[p] = min(i, first.get(p, i))
    out = []
    for i, html in pages:
        p = (html or "").encode()
        revisit = first[p] != i
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=lambda r: r[0])


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def secrets(text: str | None) -> tuple[int, int, int, str]:
    t = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(t) if len(m.group()) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(t) if len(m.group()) >= 16]
    spans.sort()
    kinds = Counter(s[3] for s in spans)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined.encode()).hexdigest()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def unigram_scores(docs: list[tuple[int, str | None]], modulus: int) -> dict[int, tuple]:
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {i: [*WORD.findall(lowered(t)), None] for i, t in docs}
    counts = Counter(w for i, ws in tokens.items() if remainder(i, modulus) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (remainder(i, modulus) == 2, len(ws), sum(w in counts for w in ws), n, math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        for i, ws in tokens.items()
    }


def word_counts(docs: list[tuple[int, str | None]], modulus: int) -> tuple[dict, int]:
    """Training counts of words, of ends under None, and of all."""
    counts = Counter(w for i, t in docs if remainder(i, modulus) != 2 for w in [*WORD.findall(lowered(t)), None])
    return counts, sum(counts.values())


def pieces(docs: list[tuple[int, str | None]], capacity: int, end_id: int) -> list[tuple]:
    """(doc_id, piece, start, length, crc32 of ids) of every document's pieces, by the vocabulary's own tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def next_id_probabilities(model, ids: list[int], end: int = 50_256, block: int = 16) -> np.ndarray:
    """P(id) of every id after ``ids`` from a text's beginning, one position at a time in double precision."""
    p, c = {k: v.astype(float) for k, v in model.p.items()}, model.classes
    place = len(ids) % block
    seen = ([end] * (block + 1) + ids)[-(block + place + 1) :]  # what the position's block and the one before it were given
    e = p["e"][c.embed[seen]]
    own = e[-1]
    s = e @ p["k"] @ (own @ p["q"]) / np.sqrt(p["q"].shape[1]) + p["rel"][np.arange(len(seen))[::-1]]
    s = np.exp(np.minimum(s, 60))
    u = np.clip((s / s.sum() @ (e @ p["v"]) + own) @ p["w1"] + p["b1"], 0, 8)
    group = np.exp(u @ p["wg"] + p["bg"])
    group /= group.sum()
    members = np.where(c.exists, np.exp(u @ p["wc"] + p["bc"]), 0).reshape(c.groups, -1)
    classes = (group[:, None] * members / members.sum(1, keepdims=True)).ravel()
    return classes[c.of] * np.exp(c.share[c.of[(ids or [end])[-1]]].astype(float))


def lm_score(model, begins: np.ndarray, words: list[list[int]], counts: list[int], ends: int, total: int, mix: float, end: int = 50_256) -> tuple[float, float]:
    """log10 probability of a text, mixed with word shares, and unmixed; ``words`` are ids of each word."""
    seen: list[int] = []
    score = attention = 0.0
    for word, c in [*zip(words, counts), ([end], ends)]:
        chain = -math.log10(next_id_probabilities(model, seen)[begins].sum())
        for i in word:
            chain += math.log10(next_id_probabilities(model, seen)[i])
            seen.append(i)
        if word != [end]:
            chain += math.log10(next_id_probabilities(model, seen)[begins].sum())
        score += math.log10(mix * c / total + (1 - mix) * 10**chain)
        attention += chain
    return score, attention


def fingerprint(text: str | None, words: int = 4) -> int:
    w = WORD.findall(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def components(prints: dict[int, int], bits: int = 4) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_components(docs: list[tuple[int, str | None]], words: int = 5) -> dict[int, int]:
    """Smallest id reachable over five-word Jaccard similarities of 0.8 or more."""
    sets = {}
    for i, t in sorted(docs):
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}
    root = {i: i for i in sets}
    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = root[a], root[b]
            if x != y and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root


def edits_within(pattern: str, text: str) -> int:
    """Least edits between ``pattern`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        left = i + 1
        new = [left]
        for j, d in enumerate(text):
            left = min(left + 1, row[j + 1] + 1, row[j] + (c != d))
            new.append(left)
        row = new
    return min(row)


def leaks(docs: list[tuple[int, str]], items: list[tuple[int, str]], window: int = 80, rate: float = 1 / 16) -> list[tuple]:
    """``(doc_id, item_id, windows found, windows, edits)``: every window of every item against every place of every text."""
    fold = lambda t: re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", t.lower()).strip(" ")
    out = []
    for d, text in docs:
        place = np.array([ord(c) for c in fold(text)])
        for i, item in items:
            item = fold(item)
            starts = [0] if len(item) <= window else [*range(0, len(item) - window, window // 2), len(item) - window]
            least = []
            for at in starts:
                row = np.zeros(len(place) + 1, int)
                for n, c in enumerate(item[at : at + window]):
                    row = np.minimum(np.concatenate(([n + 1], row[:-1] + (place != ord(c)))), row + 1)
                    row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
                least.append((row.min(), int(len(item[at : at + window]) * rate)))
            found = [e for e, most in least if e <= most]
            if found:
                out.append((d, i, len(found), len(starts), int(sum(found))))
    return out
