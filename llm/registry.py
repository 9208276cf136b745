"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, lm_score, packing, quality_rules, resampling, secrets_scan, sharding, simhash, spelling, toxicity, warc_zip
from .common import is_held_out, shared_dir, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_zip.round_trip(table(spark, sf_dir, "pages"), revisit_from=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets_scan.Ledger(spark, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    return secrets_scan.scan_documents(table(spark, sf_dir, "documents"), ledger).drop("blob")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, held_out=4)
    return language_id.identify(docs, model).select("doc_id", is_held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=4)
    return toxicity.score(docs, model).select(
        "doc_id", is_held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"), held_out=7)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES[-1])
    base = quality_rules.Policy("base", 1, ("few_words", "repeated_windows"))
    return found.withColumn("base_failed", quality_rules.rejected(base)).drop("policy")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), shortest=7, fewest=2, ratio=10, damage=31)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, percent=25, seed=7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc_zip": op2_warc_zip,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_lm_score": op7_lm_score,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_decontamination": op9_decontamination,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_importance_resampling": op13_importance_resampling,
}

RULE_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality_rules.RULES)


def _mask(names: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in quality_rules.RULES if r.name in names)


def policy_sql(policy: quality_rules.Policy) -> str:
    """Whether ``fail_bits`` pass a policy."""
    return f"((fail_bits & {_mask(policy.hard)}) = 0 AND bit_count(fail_bits & {_mask(policy.soft)}) < {policy.most_soft})"


#: CRC-32 of a string's bytes by the usual table, which a rule makes: DuckDB has no such function.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc_sql(text: str) -> str:
    """The CRC-32 of a text as SQL over ``crc_table``'s ``t``."""
    octets = f"list_transform(string_split_regex(rtrim(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g')), ' '), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: A-Z lowered, as DuckDB's lower() would lower other letters too.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {LOWERED} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op11_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
        reps AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS at FROM again) GROUP BY r),
        m AS (SELECT w.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
          len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words,
          len(regexp_extract_all(t, '\p{{L}}[^\x20\x09-\x0D]*')) AS n_letter_words FROM w LEFT JOIN reps USING (r)),
        b AS (SELECT *, {RULE_BITS} AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letter_words, CAST(fail_bits AS BIGINT) AS fail_bits,
          {policy_sql(quality_rules.POLICIES[-1])} AS kept, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE {CRC_TABLE},
        d AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
          FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents) GROUP BY 1, 2),
        h AS (SELECT run, c, {crc_sql("doc_id || ':' || run")} AS h FROM d, crc_table),
        cut AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM h),
        counts AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
        variants AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS v FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM counts)),
        near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM variants a JOIN counts b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM variants a JOIN counts b ON a.v = b.word),
        best AS (SELECT word, count(*) AS n_near, max(other_n) AS near_n FROM near GROUP BY word),
        formed AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * c.n THEN near_n END AS form_n,
          CASE WHEN near_n >= 10 * c.n THEN (SELECT min(other) FROM near x WHERE x.word = c.word AND x.other_n = near_n) END AS form FROM counts c LEFT JOIN best USING (word)),
        chain AS (SELECT word, word AS at FROM formed UNION SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, f.n, f.n_near, f.form_n, c.at AS root FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at AND e.form IS NULL""",
    "op13_importance_resampling": rf"""
        WITH {CRC_TABLE},
        docs AS (SELECT row_number() OVER () AS r, 0 AS side, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        goal AS (SELECT row_number() OVER () AS r, 1 AS side, NULL::BIGINT AS doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        each AS (SELECT side, r, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM (SELECT * FROM docs UNION ALL SELECT * FROM goal)),
        f AS (SELECT side, r, f, count(*) AS c FROM each GROUP BY 1, 2, 3),
        b AS (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), crc_table),
        fb AS (SELECT side, r, c, bucket FROM f JOIN b USING (f)),
        s AS (SELECT bucket, coalesce(sum(c) FILTER (side = 0), 0) AS s, coalesce(sum(c) FILTER (side = 1), 0) AS t FROM fb GROUP BY 1),
        gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM s) + 10000)::DOUBLE))) AS BIGINT) AS g FROM s),
        w AS (SELECT r, CAST(sum(c) AS BIGINT) AS n_features, CAST(floor(sum(c * g)::DOUBLE / sum(c)::DOUBLE) AS BIGINT) AS weight FROM fb JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
        sc AS (SELECT d.doc_id, len(ws) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
          coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
          FROM docs d LEFT JOIN w USING (r)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place FROM sc)
        SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= 25 * (SELECT count(*) FROM sc WHERE n >= 20) // 100 THEN place END AS rank FROM ranked""",
}
