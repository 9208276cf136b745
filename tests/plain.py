"""Plain, one-by-one versions of what SQL cannot check. No Spark."""

from __future__ import annotations

import re


def longest_common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 200.0 * longest_common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    full_a = f"{both} {' '.join(sorted(left - right))}".strip()
    full_b = f"{both} {' '.join(sorted(right - left))}".strip()
    if both and both in (full_a, full_b):
        return 100.0
    return max([ratio(full_a, full_b)] + ([ratio(both, full_a), ratio(both, full_b)] if both else []))


def partial_ratio(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    return max(ratio(short, long[max(0, at) : at + len(short)]) for at in range(1 - len(short), len(long)))


def matched(canon: dict[int, str], entries: dict[int, str], semantic: dict[tuple[int, int], float], pairs: set[tuple[int, int]]) -> dict[int, tuple]:
    """Each item's entry, score and reason: token set, then stretches, then the semantic score; the first entry among equals."""
    out = {}
    for item, text in canon.items():
        for reason, score_of, least in (
            ("near_dup_rapidfuzz", lambda e: token_set_ratio(text, entries[e]), 85), ("near_dup_partial", lambda e: partial_ratio(text, entries[e]), 88),
            ("ngram+ner_signature", lambda e: 100 * semantic.get((item, e), -1), 0),
        ):
            best = None
            for e in sorted(entries):
                if (item, e) in pairs and (reason[0] == "n" and (reason == "ngram+ner_signature" or (text and entries[e]))):
                    score = score_of(e)
                    if score >= least and (best is None or score > best[1]):
                        best = (e, score, reason)
            if best:
                out[item] = (best[0], best[1] / 100, best[2])
                break
    return out


def one_by_one(order: list[int], index: list[int], accepted: dict[tuple[int, int], list[tuple[int, float, str]]]) -> dict[int, tuple]:
    """Items in order, each to the best entry or a cluster of its own. ``accepted[item, entry]`` has (stage, score, reason);
    entries are positive, an item as a founder is its negative number; founders come before the index, the latest first."""
    entries, out = list(index), {}
    for item in order:
        found = [(stage, -score, at, e, reason) for at, e in enumerate(entries) for stage, score, reason in accepted.get((item, e), ())]
        if found:
            stage, score, _, e, reason = min(found)
            out[item] = (e, reason)
        else:
            entries.insert(0, -item)
            out[item] = (-item, "new_cluster")
    return out


SCRIPT_SAMPLES = {
    "ab": "LATIN", "слово ab": "CYRILLIC", "ab слово x": "CYRILLIC", "نص": "ARABIC", "טקסט": "HEBREW", "κείμενο": "GREEK", "पाठ": "DEVANAGARI", "漢字": "HAN", "ひらがな": "HIRAGANA",
    "カタカナ": "KATAKANA", "한국어": "HAN", "ქართული ab": "OTHER", "12 34": "OTHER", "": "OTHER", "ab сл": "LATIN", "сл ab": "CYRILLIC",
}


def page_text(html: str) -> str:
    import html as references

    shown = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", html)
    return references.unescape(re.sub(r"<!?[a-zA-Z/][^>]*>", "", shown)).strip()
