"""Text columns. Patterns name their classes, as the dialects differ on ``\\w`` and ``\\b``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "to", "of", "in", "on", "at", "for", "from", "with", "by", "as", "is", "are", "was", "were", "be", "been",
    "being", "this", "that", "these", "those", "it", "its", "they", "them", "their", "we", "you", "said", "says", "say", "report", "reports", "reported",
    "according", "via", "new", "latest", "breaking", "news",
)
# Units of time windows and their letters.
UNITS = {"hour": "h", "day": "d", "week": "w", "month": "m", "year": "y"}
# Keyword families; the first that has a word wins.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "protest": ("protest", "protests", "demonstration", "demonstrations", "rally", "rallies", "vigil", "march"),
    "violence": ("violence", "violent", "riot", "riots", "clash", "clashes", "unrest", "uprising"),
    "death": ("death", "deaths", "toll", "killed", "killing", "executed", "executions", "casualties", "fatalities"),
    "internet": ("blackout", "shutdown", "censorship", "blocked", "disrupted", "interrupted", "internet"),
    "regime": ("regime", "government", "authorities", "security", "forces", "crackdown", "repression"),
    "sanctions": ("sanctions", "embargo", "export", "ban", "banned", "restrictions", "diplomatic"),
    "media": ("footage", "video", "videos", "images", "photos", "journalist", "journalists", "coverage"),
    "activist": ("activist", "activists", "dissident", "dissidents", "rights", "freedom"),
}
# Media file endings.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg")
VIDEO_ENDINGS = ("mp4", "webm", "mov", "avi", "mkv", "m4v")

# Patterns. Word characters are letters, digits and underscore of any script.
W = r"[\p{L}\p{N}_]"
URL = r"https?://\S+"
RT = r"(?i)^\s*RT\s+@[A-Za-z0-9_]+:\s*"
MENTION, HASHTAG = f"@{W}+", f"#{W}+"
EMOJI = r"[\x{1F000}-\x{1FAFF}]+"
PUNCTUATION = r"[^\p{L}\p{N}_\s%]"
_BEFORE, _AFTER = f"(?<!{W})", f"(?!{W})"
NUMBER = rf"{_BEFORE}(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+){_AFTER}"
PERCENT = rf"{_BEFORE}([0-9]{{1,3}})\s*%(?={W})"
TIME_WINDOW = rf"(?i){_BEFORE}([0-9]{{1,3}})\s*(hour|day|week|month|year)s?{_AFTER}"
ISO_DATE = rf"{_BEFORE}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_AFTER}"
YEAR = rf"{_BEFORE}(19[0-9]{{2}}|20[0-9]{{2}}|2100){_AFTER}"
DOMAIN = rf"(?i){_BEFORE}(?:[a-z0-9-]+\.)+[a-z]{{2,}}{_AFTER}"


def strip(c: Column) -> Column:
    """All white space off both ends; ``trim`` takes only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def strip_noise(c: Column) -> Column:
    """URLs, mentions, hashtags and emoji become spaces."""
    for pattern in (URL, MENTION, HASHTAG, EMOJI):
        c = F.regexp_replace(c, pattern, " ")
    return c


def strip_retweet(c: Column) -> Column:
    return F.regexp_replace(strip(c), RT, "")


def plain_words(c: Column) -> Column:
    """Punctuation but ``%`` to spaces, white space collapsed, lower case."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(c, PUNCTUATION, " "), r"\s+", " ")))


def numbers(c: Column) -> Column:
    """Plain or thousands-grouped numbers without commas, of at most ten digits."""
    found = F.transform(find_all(c, NUMBER), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.filter(found, lambda x: F.length(x) <= 10)


def percents(c: Column) -> Column:
    """``N%`` only where a word character follows, as the original rule has it."""
    return F.transform(find_all(c, PERCENT, 1), lambda x: F.concat(x, F.lit("%")))


def time_windows(c: Column) -> Column:
    """``3 days`` to ``3d``."""
    letter = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.zip_with(find_all(c, TIME_WINDOW, 1), find_all(c, TIME_WINDOW, 2), lambda n, u: F.concat(n, letter[F.lower(u)]))


def content_words(c: Column) -> Column:
    """Words of three characters or more that are no stop words."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(c, " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def canonical(c: Column) -> Column:
    """Sorted distinct content words, numbers, percents and time windows, space-joined."""
    t = strip_noise(strip_retweet(F.coalesce(c, F.lit(""))))
    tokens = F.concat(content_words(plain_words(t)), numbers(t), percents(t), time_windows(t))
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def rare_tokens(canon: Column) -> Column:
    """Canonical tokens with a digit or ``%``, or of four characters or more."""
    return F.filter(F.split(canon, " "), lambda w: (w != "") & (w.rlike(r"[0-9%]") | (F.length(w) >= 4)))


def family_of(word: Column) -> Column:
    """The keyword family of a lower-case word, or null."""
    out = F.lit(None).cast("string")
    for name, words in reversed(KEYWORDS.items()):
        out = F.when(word.isin(*words), F.lit(name)).otherwise(out)
    return out


def dealt(df: DataFrame, key: str, rows: int = 2000) -> DataFrame:
    """``df`` dealt by ``key`` over all cores, and over so many tasks that each gets about ``rows`` texts, however many there are."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), key)


def with_words(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``words``, the distinct content words of a text column, and ``hits``, the families of all keywords found.

    They are columns of their own, so that what uses them many times reads them.
    Words stay strings: of these Spark finds doubles by hash, of structs by comparing all pairs.
    """
    known = [w for words in KEYWORDS.values() for w in words]
    named = df.withColumn("words", F.split(plain_words(strip_noise(F.lower(F.coalesce(F.col(column), F.lit(""))))), " "))
    named = named.withColumn("hits", F.transform(F.filter("words", lambda w: w.isin(*known)), family_of))
    stop = F.array(*map(F.lit, STOPWORDS))
    return named.withColumn("words", F.filter(F.array_except("words", stop), lambda w: F.length(w) >= 3))


def dominant_family(hits: Column) -> Column:
    """The most frequent family; ties go to the first in the order of families."""
    counted = F.array(*[_count_of(hits, name, i) for i, name in enumerate(KEYWORDS)])
    best = F.array_max(counted)
    return F.when(best["n"] > 0, best["family"])


def _count_of(hits: Column, name: str, rank: int) -> Column:
    n = F.size(F.filter(hits, lambda h: h == name))
    return F.struct(n.alias("n"), F.lit(-rank).alias("rank"), F.lit(name).alias("family"))


def semantic_tokens(words: Column, hits: Column) -> Column:
    """``family:word`` for keywords, words with digits or ``%`` or of six characters, and ``primary_family``."""

    def token(w: Column) -> Column:
        family = family_of(w)
        return F.when(family.isNotNull(), F.concat(family, F.lit(":"), w)).when((F.length(w) >= 6) | w.rlike("[0-9%]"), w)

    primary = F.array(F.concat(F.lit("primary_"), dominant_family(hits)))
    return F.sort_array(F.array_distinct(F.array_compact(F.concat(F.transform(words, token), primary))))


def ngram_text(c: Column) -> Column:
    """Lower case, noise and punctuation to spaces, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(strip_noise(F.lower(c)), PUNCTUATION, " "), r"\s+", " "))


def ellipsis(c: Column, longest: int) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.left(c, F.lit(longest)), F.lit("..."))).otherwise(c)


def ascii_tokens(c: Column) -> Column:
    return F.transform(find_all(F.coalesce(c, F.lit("")), "[A-Za-z0-9]+"), F.lower)


def first_float(c: Column) -> Column:
    return F.regexp_extract(c, r"[-+]?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def lookup_key(c: Column) -> Column:
    """Trimmed lower case; empty is null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def normal_url(c: Column) -> Column:
    """Scheme and host in lower case."""
    head = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substr(c, F.length(head) + 1))


def keywords(c: Column, mentions: int = 3) -> Column:
    """Hashtags, then the first few mentions, in lower case."""
    at = F.slice(find_all(c, f"@({W}+)", 1), 1, mentions)
    return F.transform(F.concat(find_all(c, f"#({W}+)", 1), at), F.lower)


def media_type(url: Column) -> Column:
    ending = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.when(ending.isin(*IMAGE_ENDINGS), "image").when(ending.isin(*VIDEO_ENDINGS), "video").otherwise("link")


def record_hash(source: Column, source_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", source, source_id), 256)


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each value, in order."""
    return F.aggregate(
        values,
        F.array().cast("array<string>"),
        lambda seen, v: F.when(F.array_contains(F.transform(seen, F.lower), F.lower(v)), seen).otherwise(F.concat(seen, F.array(v))),
    )
