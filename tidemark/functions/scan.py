"""What ``text`` finds in a text, for whole texts in Arrow batches.

Spark's expressions read a text anew for every pattern, most of which look back
at each letter, and interpret what is done to each word. Here patterns start
from what a match must hold: a digit, or a dot before letters. ``\\w`` is what
``text.W`` is, but for letters that Unicode has added since 13.0, which Spark's
Java may not know yet.
"""

from __future__ import annotations

import re

import numpy as np

from . import text

WHITE = " \t\n\x0b\f\r"
_RETWEET = re.compile(r"(?ai)RT\s+@[A-Za-z0-9_]+:\s*")
_URL = re.compile(rf"https?://[^{WHITE}]+")
_MENTION, _HASHTAG, _EMOJI = re.compile(r"@\w+"), re.compile(r"#\w+"), re.compile("[\U0001f000-\U0001faff]+")
_WORD = re.compile(r"[\w%]+")
#: What is no part of a word becomes a space: of ASCII, and of the first letters of Unicode, up to Thai, by a table.
_SPACED = {c: " " for c in range(128) if not _WORD.match(chr(c))}
_TABLE = np.array([c if _WORD.match(chr(c)) else 32 for c in range(1 << 12)], np.uint32)
_SIGN = re.compile(r"[0-9%]")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?!\w)")
_PERCENT = re.compile(r"([0-9]{1,3})(?a:\s*)%(?=\w)")
_TIME_WINDOW = re.compile(r"([0-9]{1,3})(?a:\s*)(?ai:(hour|day|week|month|year)s?)(?!\w)")
_ISO_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?!\w)")
_YEAR = re.compile(r"(?:19[0-9]{2}|20[0-9]{2}|2100)(?!\w)")
_DOT = re.compile(r"\.[A-Za-z]{2}")
_DOMAIN = re.compile(r"(?<!\w)(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?!\w)")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")
_NO_HOST = re.compile(r"[^A-Za-z0-9.-]")
_STOP = frozenset(text.STOPWORDS)
_FAMILY = {w: name for name, words in reversed(text.KEYWORDS.items()) for w in words}


def strip_retweet(t: str) -> str:
    t = t.strip(WHITE)
    found = _RETWEET.match(t)
    return t[found.end() :] if found else t


def strip_noise(t: str) -> str:
    t = _URL.sub(" ", t) if "://" in t else t
    t = _MENTION.sub(" ", t) if "@" in t else t
    t = _HASHTAG.sub(" ", t) if "#" in t else t
    return t if t.isascii() or _codes(t).max() < len(_TABLE) else _EMOJI.sub(" ", t)


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)


def words(t: str) -> list[str]:
    """Runs of word characters and ``%``, as ``text.plain_words`` leaves them but for case."""
    if t.isascii():
        return t.translate(_SPACED).split()
    codes = _codes(t)
    return _TABLE[codes].tobytes().decode("utf-32-le").split() if codes.max() < len(_TABLE) else _WORD.findall(t)


def ngram_text(t: str) -> str:
    return " ".join(words(strip_noise(t.lower())))


def _starts(t: str) -> list[int]:
    """Where digits begin that no word character precedes; all matches with digits start there."""
    found = (m.start() for m in _DIGITS.finditer(t))
    return [at for at in found if not at or not (t[at - 1].isalnum() or t[at - 1] == "_")]


def _found(pattern: re.Pattern[str], t: str, starts: list[int]) -> list[re.Match[str]]:
    """Matches from left to right that do not overlap."""
    out, end = [], 0
    for at in starts:
        if at >= end and (m := pattern.match(t, at)):
            out.append(m)
            end = m.end()
    return out


def _numbers(t: str, starts: list[int]) -> list[str]:
    return [n for m in _found(_NUMBER, t, starts) if len(n := m[0].replace(",", "")) <= 10]


def _percents(t: str, starts: list[int]) -> list[str]:
    return [f"{m[1]}%" for m in _found(_PERCENT, t, starts)] if "%" in t else []


def _time_windows(t: str, starts: list[int]) -> list[str]:
    return [m[1] + text.UNITS[m[2].lower()] for m in _found(_TIME_WINDOW, t, starts)]


def domains(t: str) -> list[str]:
    """Looked for in whole runs of the characters of host names that have a dot before two letters."""
    out, end = [], 0
    for m in _DOT.finditer(t):
        lo = m.start()
        if lo < end:
            continue
        while lo > end and t[lo - 1] in _HOST:
            lo -= 1
        stop = _NO_HOST.search(t, m.start())
        end = stop.start() if stop else len(t)
        out += _DOMAIN.findall(t, lo, end + 1)  # with the character that follows
    return out


def canonical(t: str) -> str:
    """As ``text.canonical``."""
    t = strip_noise(strip_retweet(t))
    starts = _starts(t)
    found = {w for w in map(str.lower, set(words(t))) if len(w) >= 3 and w not in _STOP}
    return " ".join(sorted(found.union(_numbers(t, starts), _percents(t, starts), _time_windows(t, starts))))


def _semantic(t: str) -> list[str]:
    """As ``text.semantic_tokens`` of ``text.with_words``."""
    every = words(strip_noise(t.lower()))
    own = set(every)
    out = {w for w in own - _STOP if len(w) >= 6 or (len(w) >= 3 and not w.isalpha() and _SIGN.search(w))}
    keywords = own & _FAMILY.keys()
    if keywords:
        n = dict.fromkeys(text.KEYWORDS, 0)
        for w in keywords:
            n[_FAMILY[w]] += every.count(w)
        out -= keywords
        out.update(f"{_FAMILY[w]}:{w}" for w in keywords)
        out.add("primary_" + max(n, key=n.__getitem__))
    return sorted(out)


#: Labels of ``features`` in their order.
LABELS = ("URL", "DOMAIN", "NUM", "PERCENT", "TW", "ISO_DATE", "YEAR", "SEMANTIC")


def features(t: str) -> list[list[str]]:
    """The values of each of LABELS, each once; those with digits or of a host in the order of the text."""
    t = strip_retweet(t)
    starts = _starts(t)
    found = (
        map(str.lower, _URL.findall(t) if "://" in t else []), map(str.lower, domains(t)), _numbers(t, starts), _percents(t, starts), _time_windows(t, starts),
        [m[0] for m in _found(_ISO_DATE, t, starts)], [m[0] for m in _found(_YEAR, t, starts)],
    )
    return [*(list(dict.fromkeys(values)) for values in found), _semantic(t)]
