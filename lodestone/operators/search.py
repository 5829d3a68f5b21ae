"""Full-text search: phrases ranked by BM25, by a scan or by a postings table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, phrase_count, query_tokens, token_count, token_text, tokens

K1, B = 1.2, 0.75
#: Characters of a gram of a name at most.
GRAM = 3
#: What a rarer-than-not term weighs at least.
LEAST_IDF = 1e-6


def clamp_limit(limit: int | None, default: int = 20, most: int = 100) -> int:
    return default if limit is None else max(1, min(most, limit))


def bm25(found: DataFrame, tf: str = "tf", size: str = "dl", rows: str = "n_rows", average: str = "avg_dl", hits: str = "n_hits") -> DataFrame:
    """Add ``score``: the BM25 of one phrase, negative, best first."""
    idf = F.greatest(F.log((F.col(rows) - F.col(hits) + 0.5) / (F.col(hits) + 0.5)), F.lit(LEAST_IDF))
    weight = F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(size) / F.col(average)))
    return found.withColumn("score", -idf * weight)


def _add_tf(k: int) -> Callable[[Column, Column], Column]:
    return lambda n, c: n + F.get(c["tfs"], F.lit(k))


def _counts(columns: list[str], phrases: list[list[str]]) -> Column:
    """A struct of tokens in all columns (dl), and of how often each phrase stands in one of them (tfs)."""
    each = F.transform(F.array(*[token_text(F.col(c)) for c in columns]), lambda t: F.struct(token_count(t).alias("dl"), F.array(*[phrase_count(t, p) for p in phrases]).alias("tfs")))
    if len(columns) == 1:
        return F.get(each, F.lit(0))
    return let(each, lambda e: F.struct(F.aggregate(e, F.lit(0).cast("long"), lambda n, c: n + c["dl"]).alias("dl"), F.array(*[F.aggregate(e, F.lit(0).cast("long"), _add_tf(k)) for k in range(len(phrases))]).alias("tfs")))


def phrase_hits(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows in one of whose columns the phrase stands, with tf, dl and score; statistics are over all rows.

    One scan makes the totals, one row that a scalar subquery brings back, another the rows that are
    found. A query without a token finds nothing.
    """
    phrase = query_tokens(query)
    counts = _counts(columns, [phrase])
    tf = lambda c: F.get(c["tfs"], F.lit(0))
    stats = rows.select(counts.alias("_c")).select("_c.dl", tf(F.col("_c")).alias("tf")).agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avg_dl"), F.count_if(F.col("tf") > 0).alias("n_hits"))
    # an explode of what is found: a filter would work out the counts once more
    hits = rows.withColumn("_c", F.explode(F.filter(F.array(counts), lambda c: tf(c) > 0))).withColumns({"tf": tf(F.col("_c")), "dl": F.col("_c.dl")}).drop("_c")
    with_stats = hits.withColumns({c: stats.select(c).scalar() for c in ("n_rows", "avg_dl", "n_hits")})
    return bm25(with_stats).drop("n_rows", "avg_dl", "n_hits")


def search(rows: DataFrame, columns: list[str], query: str, limit: int | None = None, where: str | Column | None = None, ties: list[str] | None = None) -> DataFrame:
    """The best rows for a phrase; ``where`` filters what is shown, not what is counted."""
    found = phrase_hits(rows, columns, query)
    return (found if where is None else found.where(where)).orderBy("score", *(ties or [])).limit(clamp_limit(limit))


def search_many(rows: DataFrame, key: str, columns: list[str], queries: list[str], limit: int | None = None) -> DataFrame:
    """(query, key, tf, dl, score) of the best rows for each of many phrases, in one scan of the texts for all of them."""
    phrases = [query_tokens(q) for q in queries]
    counted = rows.select(F.col(key).alias("key"), _counts(columns, phrases).alias("_c")).select("key", "_c.dl", F.filter(F.arrays_zip(F.array(*[F.lit(q) for q in queries]).alias("query"), F.col("_c.tfs").alias("tf")), lambda c: c["tf"] > 0).alias("found"))
    hits = counted.select("key", "dl", F.explode("found").alias("f")).select("f.query", "key", "f.tf", "dl")
    corpus = counted.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avg_dl"))
    n = hits.groupBy("query").agg(F.count("*").alias("n_hits"))  # a row for each query
    ranked = bm25(hits.join(F.broadcast(n), "query").withColumns({c: corpus.select(c).scalar() for c in ("n_rows", "avg_dl")}))
    best = Window.partitionBy("query").orderBy("score", "key")
    return ranked.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= clamp_limit(limit)).select("query", "key", "tf", "dl", "score")


def postings(rows: DataFrame, key: str, columns: list[str], buckets: int = 64) -> DataFrame:
    """(bucket, token, key, column, positions): write it partitioned by bucket, and a search reads few files."""
    each = rows.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), tokens(F.col(c)).alias("tokens")) for c in columns])).alias("c"))
    spots = each.select("key", "c.column", F.posexplode("c.tokens").alias("position", "token"))
    grouped = spots.groupBy("token", "key", "column").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return grouped.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))


def lengths(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, dl): tokens of all columns."""
    return rows.select(F.col(key).alias("key"), reduce(lambda a, b: a + b, [token_count(token_text(F.col(c))) for c in columns]).alias("dl"))


def postings_hits(index: DataFrame, sizes: DataFrame, query: str) -> DataFrame:
    """(key, tf, dl, score) of all rows with the phrase, from ``postings`` and ``lengths``.

    Only the rows of the phrase's tokens are read; adjacency is an intersection of shifted positions,
    so phrases that repeat a token or overlap themselves count right.
    """
    phrase = query_tokens(query)
    if not phrase:
        return index.limit(0).select("key", F.lit(0).alias("tf"), F.lit(0).cast("long").alias("dl"), F.lit(0.0).alias("score"))
    own = index.where(F.col("token").isin(sorted(set(phrase))))
    at = own.groupBy("key", "column").agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"))
    hit = reduce(F.array_intersect, [_shifted(t, k) for k, t in enumerate(phrase)])
    tf = at.groupBy("key").agg(F.sum(F.size(hit)).alias("tf")).where("tf > 0")
    found = tf.join(sizes, "key")
    total = sizes.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avg_dl"))
    with_stats = found.withColumns({"n_rows": total.select("n_rows").scalar(), "avg_dl": total.select("avg_dl").scalar(), "n_hits": tf.agg(F.count("*").alias("n")).scalar()})
    return bm25(with_stats).select("key", "tf", "dl", "score")


def search_postings(index: DataFrame, sizes: DataFrame, query: str, limit: int | None = None, buckets: int = 64) -> DataFrame:
    """The best of ``postings_hits``; of postings that are written by bucket, those of the phrase's tokens are read."""
    own = F.col("bucket").isin(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)) for t in sorted(set(query_tokens(query)))])
    return postings_hits(index.where(own) if query_tokens(query) else index, sizes, query).orderBy("score", "key").limit(clamp_limit(limit))


def _shifted(token: str, by: int):
    none = F.array().cast("array<int>")
    return F.transform(F.coalesce(F.try_element_at("at", F.lit(token)), none), lambda p: p - by)


def name_grams(symbols: DataFrame) -> DataFrame:
    """(gram, symbol_id): each run of up to GRAM characters of each name in lower case, once; written sorted by gram, a search reads few files."""

    def of_size(low: Column, n: int) -> Column:
        return F.when(F.char_length(low) >= n, F.transform(F.sequence(F.lit(1), F.char_length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = let(F.lower("name"), lambda low: F.array_distinct(F.concat(*[of_size(low, n) for n in range(1, GRAM + 1)])))
    return symbols.select(F.explode(grams).alias("gram"), F.col("id").alias("symbol_id"))


def query_grams(query: str) -> list[str]:
    """The grams that a name has if it contains the query, whose ``%`` and ``_`` are wildcards unless a backslash stands before them."""
    runs, escaped = [""], False
    for c in query.lower():
        if not escaped and c == "\\":
            escaped = True
        elif not escaped and c in "%_":
            runs.append("")
        else:
            runs[-1], escaped = runs[-1] + c, False
    return sorted({r[i : i + GRAM] for r in runs if r for i in range(max(1, len(r) - GRAM + 1))})


def with_grams(grams: DataFrame, query: str) -> DataFrame | None:
    """(symbol_id) of the names that have all grams of the query; None where it has none, as every name may fit."""
    wanted = query_grams(query)
    if not wanted:
        return None
    return grams.where(F.col("gram").isin(wanted)).groupBy("symbol_id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted)).select("symbol_id")


def search_symbols(symbols: DataFrame, files: DataFrame, query: str, kinds: list[str] | None = None, exported: bool | None = None, repository_id: str | None = None, limit: int | None = None, grams: DataFrame | None = None) -> DataFrame:
    """Symbols whose name contains the query, in any case of A-Z; ``%`` and ``_`` in it are wildcards.

    With ``grams`` only symbols that have all of the query's are looked at; the pattern then verifies them.
    """
    candidates = None if grams is None else with_grams(grams, query)
    if candidates is not None:
        symbols = symbols.join(candidates.withColumnRenamed("symbol_id", "id"), "id", "left_semi")
    found = symbols.where(F.col("name").ilike(f"%{query}%"))
    if kinds:
        found = found.where(F.col("kind").isin(kinds))
    if exported is not None:
        flag = F.get_json_object("metadata", "$.is_exported")
        found = found.where((flag == "true") if exported else F.coalesce(flag != "true", F.lit(True)))
    if repository_id is not None:
        found = found.where(F.col("repository_id") == repository_id)
    of = files.select(F.col("id").alias("file_id"), "path")
    return found.join(of, "file_id").select("id", "name", "kind", "signature", "documentation", "path", "line_start", "line_end", "metadata").orderBy("name", "path", "line_start").limit(clamp_limit(limit))


def recent(rows: DataFrame, time: str, limit: int, ties: list[str], where: str | Column | None = None) -> DataFrame:
    """The newest rows, for recent files, patterns and metrics."""
    return (rows if where is None else rows.where(where)).orderBy(F.col(time).desc(), *ties).limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
