"""Operator 3, secret scans: an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256. A ledger says which
(blob, rule version) pairs have been scanned; only blobs that miss a pair are
scanned, once however many paths hold them, and findings join back to all paths.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, utf8, with_found

#: Kinds whose spans are the base ones, in the order ties are listed.
BASE_KINDS = ("assign", "access", "hex")


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern and what a match must hold to count."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0
    min_entropy: float = 0.0

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(repr(self).encode()).hexdigest()[:12]}"

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches that pass, as code point spans."""
        out = []
        for m in compiled.finditer(text):
            value = m.group(self.group)
            if len(value) >= self.min_length and (not self.min_entropy or _entropy(value) >= self.min_entropy):
                out.append(m.span())
        return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The first three are the contract's base rules; the others are ours.
RULES: tuple[Rule, ...] = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # every run of at least 16 is a whole run, so shorter runs need no match
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{4,64}@"),
)

LEDGER = "blob string, rule string"
FINDINGS = "blob string, rule string, kind string, start long, end long"


def _scan_schema() -> str:
    return "blob string, spans array<struct<rule:string,kind:string,start:long,end:long>>, asked array<string>"


class Ledger:
    """Scans and findings kept under ``folder``, which driver and executors share.

    Each recording is a folder of its own, findings first, so a recording that
    broke off is done again and changes nothing. Only what Spark wrote whole is
    read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/*").distinct()

    def scans(self) -> DataFrame:
        """``(blob, rule)`` pairs that have been scanned."""
        return self._read("scans", LEDGER)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS)

    def record(self, findings: DataFrame, scans: DataFrame) -> None:
        batch = uuid.uuid4().hex
        findings.write.parquet(f"{self.folder}/findings/{batch}")
        scans.write.parquet(f"{self.folder}/scans/{batch}")


def blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, blob)``: every path and the address of a version it holds; a path may have many."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(utf8(text_col), 256).alias("blob"))


def _leaving(docs: DataFrame, holders: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(blob, path, body)`` of the rows that leave their tasks.

    Of a blob with over a thousandth of all rows (there are at most 1,000) only
    the holder's row does, and none where it misses no rule; of others every row.
    """
    total = holders.agg(F.sum("paths")).first()[0] or 0
    hot = holders.filter(F.col("paths") * 1000 > total).select(
        F.col("of_blob").alias("hot_blob"), F.struct("holder", (F.size("missing") > 0).alias("open")).alias("hot")
    )
    rows = docs.select(F.sha2(utf8(text_col), 256).alias("blob"), F.col(id_col).cast("long").alias("path"), utf8(text_col).alias("body"))
    held = F.col("hot").isNull() | (F.col("hot.open") & F.col("path").eqNullSafe(F.col("hot.holder")))
    return rows.join(F.broadcast(hot), F.col("blob") == F.col("hot_blob"), "left").filter(held).select("blob", "path", "body")


def _bring(docs: DataFrame, holders: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(blob, body, missing)`` of the blobs that miss a rule, from their holders' rows, dealt by address and path.

    Where the table of these blobs is small, as when most were scanned before,
    Spark sends it to the rows and no body travels.
    """
    wanted = holders.filter(F.size("missing") > 0)
    rows = _leaving(docs, holders, id_col, text_col)
    return rows.join(wanted, [F.col("blob") == F.col("of_blob"), F.col("path").eqNullSafe(F.col("holder"))]).select("blob", "body", "missing")


def scan_unseen(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``(findings, new ledger rows)`` of the blobs of ``docs`` that miss a rule version in ``ledger``.

    The blobs to scan are found on addresses alone, and one path is picked to
    bring each, see ``_bring``. Findings and ledger rows are written tables. A
    blob is scanned only for the rules it misses.
    """
    versions = [r.version for r in rules]
    missing = F.array(*[F.lit(v) for v in versions])
    holders = blobs(docs, id_col, text_col).groupBy("blob").agg(F.min("doc_id").alias("holder"), F.count("*").alias("paths"))
    if ledger is not None:
        known = ledger.filter(F.col("rule").isin(versions)).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        holders = holders.join(known, "blob", "left")
        missing = F.array_except(missing, F.coalesce("done", F.array().cast("array<string>")))
    holders = materialize(holders.select(F.col("blob").alias("of_blob"), "holder", "paths", missing.alias("missing")), "secret-holders")
    brought = _bring(docs, holders, id_col, text_col)

    compiled = [(r, re.compile(r.pattern)) for r in rules]

    def scan(batches):
        kind = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            seen: set[str] = set()  # a row may be repeated with its id
            blob, out, asked = [], [], []
            for b, body, todo in zip(*(c.to_pylist() for c in batch.columns)):
                if b in seen:
                    continue
                seen.add(b)
                text = body.decode()
                out.append([{"rule": r.version, "kind": r.kind, "start": s, "end": e} for r, p in compiled if r.version in todo for s, e in r.spans(text, p)])
                blob.append(b)
                asked.append(todo)
            yield pa.RecordBatch.from_arrays([pa.array(blob, pa.string()), pa.array(out, kind), pa.array(asked, pa.list_(pa.string()))], names=["blob", "spans", "asked"])

    scanned = materialize(brought.mapInArrow(scan, _scan_schema()).dropDuplicates(["blob"]), "secret-scan")
    findings = scanned.select("blob", F.explode("spans").alias("s")).select("blob", "s.*")
    return findings, scanned.select("blob", F.explode("asked").alias("rule"))


def findings_of_paths(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path with its blob's findings: counts per base kind, digest of base spans, all spans.

    Spans are listed by start, then kind as in the rules. Paths without
    findings have counts of zero and empty lists.
    """
    order = {r.kind: i for i, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    listed = findings.select("blob", F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind").alias("s"))
    per_blob = listed.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("found"))
    sizes = paths.groupBy("blob").agg(F.count("*").alias("paths"))
    per_blob = materialize(sizes.join(per_blob, "blob", "left"), "secret-blobs")
    joined = with_found(paths, per_blob, ["blob"], "paths").withColumn("found", F.coalesce("found", F.array().cast(per_blob.schema["found"].dataType)))

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select("doc_id", *map(count, BASE_KINDS), F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"), "blob")


def scan_documents(
    docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Findings of every row of ``docs``; what ``ledger`` has is not scanned again, and what is scanned is recorded in it.

    Findings are those of ``rules`` in their present versions. Defined results:
    null texts are the empty blob, which has no findings; equal texts share one
    scan; a path with several texts, its versions, has a row for each; repeated
    rows are returned each; null ids are kept; an empty table gives an empty
    result; other columns are ignored.
    """
    paths = materialize(blobs(docs, id_col, text_col), "secret-paths")
    if ledger is None:
        findings, _ = scan_unseen(docs, None, rules, id_col, text_col)
        return findings_of_paths(paths, findings, rules)
    ledger.record(*scan_unseen(docs, ledger.scans(), rules, id_col, text_col))
    here = paths.select("blob").distinct()
    known = ledger.findings().filter(F.col("rule").isin([r.version for r in rules])).join(here, "blob", "left_semi")
    return findings_of_paths(paths, known, rules)
