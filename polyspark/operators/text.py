"""Full-text search: tokens, conjunctive search and BM25 ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]"


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits in lower case."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", query.lower()) if t]


def json_leaves(doc: Column | str) -> Column:
    """All string leaves of a JSON text, joined; what is not JSON counts as plain text."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    pattern = F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?')  # a string, and the colon that makes it a field name
    parts = F.arrays_zip(F.regexp_extract_all(doc, pattern, F.lit(1)).alias("s"), F.regexp_extract_all(doc, pattern, F.lit(2)).alias("colon"))
    strings = F.transform(F.filter(parts, lambda p: p["colon"] == ""), lambda p: p["s"])
    return F.when(F.try_parse_json(doc).isNull(), doc).otherwise(F.array_join(strings, " "))


def _whole(word: str) -> str:
    """A pattern of the word as a whole token; the letters come first, so places without them are passed over quickly."""
    return rf"\Q{word}\E(?<!{TOKEN}\Q{word}\E)(?!{TOKEN})"


def text_search(docs: DataFrame, key: str, text: str, query: str, is_json: bool = False) -> DataFrame:
    """Keys of the documents that hold every token of the query; an empty query finds nothing.

    A plain substring test goes before each pattern, so most texts are settled without cutting them into tokens.
    """
    wanted = sorted(set(query_tokens(query)))
    if not wanted:
        return docs.select(key).limit(0)
    low = F.lower(json_leaves(text) if is_json else F.col(text))
    hit = F.lit(True)
    for w in wanted:
        hit = hit & F.contains(low, F.lit(w))
    for w in wanted:
        hit = hit & low.rlike(_whole(w))
    return docs.where(hit).select(key)


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score) of documents with any query token; a token that the query repeats counts as often.

    One pass over the texts makes a narrow row of token counts for each document, which is stored; statistics (one row) and
    scores come from these rows.
    """
    terms = query_tokens(query)
    unique = sorted(set(terms))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    count = lambda w: F.when(F.contains(low, F.lit(w)), F.regexp_count(low, F.lit(_whole(w)))).otherwise(0)
    rows = stored(docs.select(key, F.regexp_count(low, F.lit(TOKEN + "+")).alias("_dl"), *(count(w).alias(f"_tf{i}") for i, w in enumerate(unique))), "bm25")
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *(F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"_df{i}") for i in range(len(unique))))
    score = F.lit(0.0)
    for i, w in enumerate(unique):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1)
        score = score + terms.count(w) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    hit = F.greatest(*(F.col(f"_tf{i}") for i in range(len(unique))), F.lit(0)) > 0 if unique else F.lit(False)
    return rows.where(hit).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))


def bm25_topk(docs: DataFrame, key: str, text: str, query: str, k: int = 10) -> DataFrame:
    return bm25(docs, key, text, query).orderBy(F.col("score").desc(), key).limit(k)
