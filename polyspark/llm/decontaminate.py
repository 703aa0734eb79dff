"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The test side is cut into windows of consecutive words. Training documents, whose words are cut once and stored, give
postings (term, document, position), kept for the terms that the windows' anchors need: for each window its two rarest terms
in the training data. Every posting is moved back by its term's offset in the window. Where the lists of both anchors meet,
the window may start; those starts are then compared word by word with the document, which gives exact phrase matches.
Where the lists miss each other by a few words at most, the window has a proximity match.

Document frequencies and anchors follow all documents. Words are dealt out by document once; postings are made, sorted,
intersected and verified where their document lies, so no list of a term or a window is ever gathered, and a passage that a
third of all documents share is spread by document. The test side is broadcast only below a checked size; beyond it the same
joins run as shuffled joins.

Nulls and edges: a null text has no words; an item without words has no window and occurs nowhere; an item of fewer words
than a window is one window; rows with a null id are ignored on the test side and are documents as any other on the training
side; rows that repeat an id are judged each by their own text; repeated items count once; empty tables give zero hits or an
empty result; other columns of the inputs are never read, but for those named to be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stash import Stash

WINDOW = 10
#: Words that the rarest two terms of a window may stand off their distance in a proximity match.
SLOP = 2
#: Bytes of values up to which a part of the test side is broadcast.
BROADCAST_BYTES = 8 << 20
KEY = ("k1", "k2", "bare")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(plain, SEPARATORS, -1), "")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(win, items, wid): each distinct window once, with the ids of the items that have it. ``wid`` is a hash; windows that share one are told apart by their words."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws"))
    rows = rows.where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    each = rows.select("item", "ws", F.explode(starts).alias("at")).select("item", F.slice("ws", F.col("at"), F.lit(size)).alias("win"))
    return each.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("wid", F.xxhash64(F.concat_ws(" ", "win")))


def bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint where the table's values are checked to be small, as text with 16 bytes for each; the plain table otherwise."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16 * len(df.columns)).alias("n")).first().n or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def anchors(wins: DataFrame, frequency: DataFrame) -> DataFrame:
    """(wid, term, off, bit, alone): the two rarest distinct terms of each window, as bits 1 and 2; ``alone`` where it has one term only."""
    terms = wins.select("wid", "win", F.posexplode("win").alias("off", "term")).groupBy("wid", "win", "term").agg(F.min("off").alias("off"))
    terms = terms.join(frequency, "term", "left").select("wid", "win", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "off").alias("t"))
    picked = terms.groupBy("wid", "win").agg(F.slice(F.array_sort(F.collect_list("t")), 1, 2).alias("ts"))
    return picked.select("wid", (F.size("ts") == 1).alias("alone"), F.posexplode("ts").alias("no", "t")).select("wid", "alone", (F.col("no") + 1).alias("bit"), "t.term", "t.off")


def split_words(line: str) -> Column:
    """Words that stand in one string, with a space between: a third of an array's bytes when rows move."""
    return F.array_remove(F.split(line, " ", -1), "")


def frequencies(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(term, df): how often each word of the test side stands in all documents."""
    vocabulary = bounded(wins.select(F.explode("win").alias("term")).distinct())
    return docs.select(F.explode(split_words("line")).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))


def matches(docs: DataFrame, anchored: DataFrame, slop: int) -> DataFrame:
    """(document, wid, starts): windows whose moved anchor lists come within ``slop`` words of each other, and the starts where they meet.

    ``docs`` has the columns of KEY and line, dealt out by document; nothing here moves them. In the order of moved places, the
    closest places of both terms are neighbours, so one look at the row before tells.
    """
    found = bounded(anchored)
    moved = docs.select(*KEY, F.posexplode(split_words("line")).alias("pos", "term")).join(found, "term").select(*KEY, "wid", (F.col("pos") - F.col("off")).alias("start"), "bit", "alone")
    w = Window.partitionBy(*KEY, "wid").orderBy("start", "bit")
    moved = moved.withColumn("other", F.lag("bit").over(w) != F.col("bit")).withColumn("gap", F.col("start") - F.lag("start").over(w))
    close = moved.where(F.col("alone") | (F.col("other") & (F.col("gap") <= slop)))
    exact = (F.col("start") >= 0) & (F.col("alone") | (F.col("gap") == 0))
    return close.groupBy(*KEY, "wid").agg(F.collect_set(F.when(exact, F.col("start"))).alias("starts"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, keep: tuple[str, ...] = (), slop: int = 0) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit (words inside any occurrence of a window), item_ids (sorted), near_ids; and the columns in ``keep``.

    near_ids are the sorted ids of items of which the two rarest terms of a window stand at most ``slop`` words off their distance in it.
    """
    stash = Stash(docs.sparkSession, "decontaminate")
    ident, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    # A row is known by its id and a hash of id and text, so that rows without an id, or with one id, stay apart.
    key = (F.coalesce(ident, F.lit(0)).alias("k1"), F.xxhash64(ident, text).alias("k2"), ident.isNull().alias("bare"))
    lines = stash.put(docs.select(*key, F.array_join(words(F.col(text_col)), " ").alias("line")))
    wins = stash.put(windows(items, size=size))
    anchored = stash.put(anchors(wins, frequencies(lines, wins)))
    rows = lines.where("k1 is not null and k2 is not null").repartition("k1", "k2")  # never null, but said so both uses share one shuffle
    met = matches(rows, anchored, slop).join(bounded(wins), "wid")
    per_doc = met.groupBy(*KEY).agg(F.collect_list(F.struct(F.when(F.size("starts") > 0, F.col("win")).alias("win"), "items", "starts")).alias("cand")).drop("bare")
    full = rows.join(per_doc.hint("merge"), ["k1", "k2"], "left").select(*KEY, "cand", split_words("line").alias("ws"))
    found = F.transform("cand", lambda c: F.struct(c["items"].alias("items"), F.size(c["win"]).alias("n"), F.filter(c["starts"], lambda s: F.slice("ws", s + 1, F.size(c["win"])) == c["win"]).alias("starts")))
    full = full.select(*KEY, F.size("ws").cast("long").alias("n_words"), found.alias("cand"))
    hits = F.filter("cand", lambda c: F.size(c["starts"]) > 0)
    places = F.array_distinct(F.flatten(F.flatten(F.transform(hits, lambda c: F.transform(c["starts"], lambda s: F.sequence(s, s + c["n"] - 1))))))
    ids = lambda c: F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda x: x["items"])))), F.expr("cast(array() as array<string>)"))
    full = full.select("k1", "k2", F.when(~F.col("bare"), F.col("k1")).alias("doc_id"), "n_words", F.greatest(F.size(F.coalesce(places, F.expr("cast(array() as array<int>)"))), F.lit(0)).cast("long").alias("n_hit"), ids(hits).alias("item_ids"), ids(F.col("cand")).alias("near_ids"))
    if not keep:
        return full.drop("k1", "k2")
    kept = docs.select(*key[:2], *keep)
    return full.dropDuplicates(["k1", "k2"]).join(kept.hint("merge"), ["k1", "k2"]).select("doc_id", *keep, "n_words", "n_hit", "item_ids", "near_ids")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=SLOP)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near_ids", ","), 256).alias("near_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT DISTINCT item, array_to_string(list_slice(ws, i, i + 9), ' ') AS win, least(len(ws), 10) AS n FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM w), p AS (
  SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hit AS (SELECT p.doc_id, p.i, p.n, w.item FROM p JOIN w ON p.win = w.win AND p.n = w.n
), h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
), o AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM d
), f AS (SELECT term, count(*) AS df FROM o GROUP BY term
), x AS (SELECT win, term, min(off) AS off FROM (SELECT win, unnest(string_split(win, ' ')) AS term, unnest(range(n)) AS off FROM (SELECT DISTINCT win, n FROM w)) GROUP BY win, term
), a AS (SELECT win, term, off, row_number() OVER (PARTITION BY win ORDER BY coalesce(df, 0), term) AS r, count(*) OVER (PARTITION BY win) AS terms FROM x LEFT JOIN f USING (term)
), y AS (SELECT DISTINCT doc_id, win, r, terms, pos - off AS s FROM o JOIN a USING (term) WHERE r <= 2
), z AS (SELECT DISTINCT p.doc_id, p.win FROM y p JOIN y q ON p.doc_id = q.doc_id AND p.win = q.win AND q.r = 2 AND abs(p.s - q.s) <= 2 WHERE p.r = 1 UNION SELECT doc_id, win FROM y WHERE terms = 1
), e AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near FROM (SELECT DISTINCT doc_id, item FROM z JOIN w USING (win)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN e ON d.doc_id = e.doc_id
"""
