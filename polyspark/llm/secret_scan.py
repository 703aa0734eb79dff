"""Secret scan over a content-addressed ledger of text versions, with DataFrame functions only.

Every version of a text is addressed by its SHA-256. A (blob, rule, rule version) triple is scanned once ever: what the
ledger already holds is left out before any pattern runs, so a new rule version rescans blobs for that rule alone and an
unchanged text under a new path costs a hash. Findings are kept per blob and joined back to all of its paths.

Copies collapse before the shuffle (each input split sends a blob once), and the join back to paths is an equi-join whose
hot blobs adaptive execution splits.

Positions come from splitting a text at a pattern's matches: the pieces' and matches' lengths in code points add up to
the places, without any code outside the SQL functions.

Nulls and edges: a null text counts as empty, without findings; texts of any length are scanned whole; repeated (path,
text) rows give repeated results; an empty table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stash import Stash


@dataclass(frozen=True)
class Rule:
    """``kept_group`` of a match must have ``least`` code points or more; ``base`` rules count in the base columns."""

    kind: str
    pattern: str
    version: int = 1
    kept_group: int = 0
    least: int = 1
    base: bool = False


#: A greedy run that is too short fails as a whole, so the lengths of `access` and `hex` stand in their patterns.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", kept_group=2, least=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)

ROWS_A_PART = 256
SPAN = "struct<start:int,no:int,end:int,kind:string>"


def _spans(text: Column, rule: Rule, no: int) -> Column:
    """All kept matches of a rule as SPAN structs; one search decides for the many texts that have none."""
    pieces = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.kept_group)) if rule.kept_group else hits
    zipped = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"), kept.alias("kept"))

    none, full = F.expr(f"cast(array() as array<{SPAN}>)"), F.expr(f"cast(array() as array<array<{SPAN}>>)")

    def step(acc: Column, x: Column) -> Column:
        """Spans gather in parts of ROWS_A_PART, so that many matches are not copied for each new one."""
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        more = F.when(F.char_length(x["kept"]) >= rule.least, F.array(span)).otherwise(none)
        whole = F.size(acc["part"]) >= ROWS_A_PART
        part = F.when(whole, more).otherwise(F.concat(acc["part"], more))
        return F.struct(end.alias("at"), part.alias("part"), F.when(whole, F.concat(acc["out"], F.array(acc["part"]))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("part"), full.alias("out"))
    found = F.aggregate(zipped, zero, step, lambda acc: F.concat(F.flatten(acc["out"]), acc["part"]))
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blobs_of(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """Each distinct content once: (blob, text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def _versions(rules: tuple[Rule, ...]) -> Column:
    return F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(r.version))))


def pending(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``todo``, the kinds whose present rule version has not seen the blob; blobs with none are left out."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", kinds)
    seen = ledger.select("blob", F.explode("scanned").alias("x")).where(_versions(rules)[F.col("x.kind")] == F.col("x.version"))
    seen = seen.groupBy("blob").agg(F.collect_set("x.kind").alias("seen"))
    todo = F.array_except(kinds, F.coalesce(F.col("seen"), F.expr("cast(array() as array<string>)")))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0).drop("seen")


def scan_blobs(todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows: (blob, scanned, spans), with the (kind, version) pairs that were pending and what they found, be it nothing."""
    pairs = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = F.concat(*(F.when(F.array_contains("todo", r.kind), _spans(F.col("text"), r, no)).otherwise(none) for no, r in enumerate(rules)))
    return todo.select("blob", F.filter(pairs, lambda x: F.array_contains("todo", x["kind"])).alias("scanned"), found.alias("spans"))


def extend_ledger(spark: SparkSession, versions: DataFrame, ledger_path: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` (Parquet; may be missing) has not seen, append it, and return the whole ledger."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    ledger = spark.read.parquet(ledger_path) if there else None
    scan_blobs(pending(blobs_of(versions, text_col), ledger, rules), rules).write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans of every path (row of ``versions``) under the present rule versions, by place and then by rule: ledger rows with findings, joined by content."""
    now, order = _versions(rules), F.create_map(*(x for no, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(no))))
    valid = F.filter("spans", lambda s: F.exists("scanned", lambda x: (x["kind"] == s["kind"]) & (x["version"] == now[s["kind"]])))
    valid = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("no"), s["end"].alias("end"), s["kind"].alias("kind")))
    per_blob = ledger.where(F.size("spans") > 0).select("blob", valid.alias("spans")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Written first: joined straight after the aggregation, a hot blob's paths could not be split.
    per_blob = Stash(versions.sparkSession, "secrets").put(per_blob)
    paths = versions.select(F.col(id_col).cast("long").alias(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    return paths.join(per_blob, "blob", "left").select(id_col, "blob", F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"))


def scan_secrets(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """Spans of every path through the ledger at ``ledger_path``; without one, through a new ledger in the shared folder."""
    spark = versions.sparkSession
    ledger = extend_ledger(spark, versions, ledger_path or Stash(spark, "ledger").root, text_col, rules)
    return findings_by_path(versions, ledger, id_col, text_col, rules)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [no for no, r in enumerate(RULES) if r.base]

    def count(no: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["no"] == no)).cast("long").alias(f"n_{RULES[no].kind}")

    counts = [count(no) for no in base]
    plain = F.filter("spans", lambda s: s["no"] <= max(base))
    return found.select("doc_id", *counts, F.sha2(_joined(plain), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same spans in SQL: pieces between a pattern's matches and the matches add up to places."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    parts = []
    for no, r in enumerate(RULES):
        p = quote(r.pattern)
        parts.append(
            f"SELECT doc_id, {no} AS no, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, {p}) AS pieces, "
            f"regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {r.kept_group}) AS kept FROM d WHERE regexp_matches(text, {p})"
        )
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    start = f"{size.format('list_slice(pieces, 1, i)')} + {size.format('list_slice(hits, 1, i - 1)')}"
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, no, kind, CAST({start} AS BIGINT) AS a, CAST({start} + length(hits[i]) AS BIGINT) AS b FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m) WHERE length(kept[i]) >= least),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) FILTER (kind IN ({base})) AS plain FROM s GROUP BY doc_id)
SELECT d.doc_id, {zero}, sha256(coalesce(plain, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE_SQL = _oracle()
