"""Subword ids of whole batches: each distinct word of a batch is encoded once.

Byte-level BPE cuts a text before every single space between two other
characters, so a text's ids are the ids of its space-separated words in a row.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pre-tokenizer pattern that belongs to the byte-level vocabulary.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The vocabulary's added token and its id.
ADDED_TOKEN, ADDED_ID = "<|endoftext|>", 50_256
_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f" {_WHITE}|{_WHITE} "
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> str:
    """The ranks file of the 50k byte-level vocabulary; ids equal those of its .json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' words, each but a text's first with its space, and their number per text."""
    split = pc.split_pattern(texts, " ")
    count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words = split.flatten()
    return words, count


def encode_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, offsets)``: text i has ``ids[offsets[i]:offsets[i+1]]``. Null is empty.

    The vocabulary's added token is cut out first, as its tokenizer does.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not pc.any(pc.match_substring(texts, ADDED_TOKEN)).as_py():
        return _encode_plain(texts, path)
    parts = pc.split_pattern(texts, ADDED_TOKEN)
    first = np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    ids, offsets = _encode_plain(parts.flatten(), path)
    within = np.ones(len(offsets) - 1, bool)  # parts that the token follows
    within[first[1:] - 1] = False
    ids = np.insert(ids, offsets[1:][within], np.uint32(ADDED_ID))
    return ids, offsets[first] + first - np.arange(len(first))


def _encode_plain(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    enc = encoder(path)
    unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
    if unsafe.any():
        # a space beside other white space: cut only at spaces that stand alone
        count = np.empty(len(texts), np.int64)
        pieces: list[str] = []
        for i, t in enumerate(texts.to_pylist()):
            cut = _SAFE_SPACE.split(t) if unsafe[i] else t.split(" ")
            count[i] = len(cut)
            pieces += cut
        words = pa.array(pieces, pa.string())
    else:
        words, count = _words(texts)
    coded = words.dictionary_encode()
    first = np.concatenate(([0], np.cumsum(count)))
    code = coded.indices.to_numpy().astype(np.int64)
    distinct = coded.dictionary.to_pylist()
    # the same word as a text's first has no space before it
    lead, lead_of = np.unique(code[first[:-1]], return_inverse=True) if len(code) else (np.empty(0, np.int64), None)
    code[first[:-1]] = len(distinct) + lead_of if lead_of is not None else code[first[:-1]]
    encode = enc.encode_ordinary
    lists = [encode(" " + w) for w in distinct] + [encode(distinct[i]) for i in lead]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for ids in lists for x in ids), np.uint32, int(size.sum()))
    start = np.concatenate(([0], np.cumsum(size)))
    n = size[code]
    ends = np.cumsum(n)
    ids = flat[np.repeat(start[code] - (ends - n), n) + np.arange(int(n.sum()))]
    return ids, np.concatenate(([0], ends))[first]


def slices(batch: pa.RecordBatch, column: int, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes in ``column``."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
