"""Quality rules: how much of a text lies inside repeated word n-grams and lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried

#: Characters that count as symbols, as UTF-8.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
#: Repeated windows may cover so many hundredths of the words.
MAX_REPEAT = 30
#: Word n-gram length: the largest share of characters (of those in words) inside repeated n-grams.
NGRAMS = {3: 0.35, 5: 0.30, 6: 0.30, 10: 0.20}
#: The largest share of characters inside repeated lines.
MAX_LINE_CHARS = 0.20

_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ngram_cover map<int,double>, line_cover double, symbol_ratio double, base_failed boolean, kept boolean"
_TYPE = pa.struct(
    [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("ngram_cover", pa.map_(pa.int32(), pa.float64())), ("line_cover", pa.float64()), ("symbol_ratio", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def rolling(ids: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """By n-gram length: a polynomial hash of the n-gram that begins at each word."""
    out, h = {}, np.zeros(len(ids), np.uint64)
    for n in range(1, max(lengths) + 1):
        if n > len(ids):
            break
        h = h[: len(ids) - n + 1] * _BASE + ids[n - 1 :]
        if n in lengths:
            out[n] = h
    return out


def covered(ids: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Words inside n-grams that occur twice or more; equal hashes are compared word by word."""
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    same = sorted_h[1:] == sorted_h[:-1]
    mark = np.zeros(len(ids) + 1, np.int64)
    if same.any():
        left, right = order[:-1][same], order[1:][same]
        if any((ids[left + j] != ids[right + j]).any() for j in range(n)):  # a collision: number the n-grams exactly
            grams = np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0, return_inverse=True, return_counts=True)
            at = np.flatnonzero(grams[2][grams[1].reshape(-1)] > 1)
        else:
            at = np.unique(np.concatenate([left, right]))
        np.add.at(mark, at, 1)
        np.add.at(mark, at + n, -1)
    return np.cumsum(mark[:-1]) > 0


def measure(text: str | None) -> dict:
    """The measures and the verdict of one text; null has no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0D only
    n = len(words)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    chars_of = [len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in known]
    chars = np.array(chars_of, np.int64)[ids.astype(np.int64)] if n else np.zeros(0, np.int64)
    total = int(chars.sum())
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)

    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in raw.split(b"\n"):
        if inside := line.split():
            if line in seen:
                dup_lines += 1
                dup_chars += sum(chars_of[known[w]] for w in inside)
            else:
                seen.add(line)

    hashes = rolling(np.array([hash_of(w) for w in known], np.uint64)[ids.astype(np.int64)] if n else ids, [*NGRAMS, WINDOW])
    repeat, cover = 0, {}
    for k, h in hashes.items():
        mark = covered(ids, h, k)
        if k == WINDOW:
            repeat = int(mark.sum())
        if k in NGRAMS:
            cover[k] = float(chars[mark].sum()) / total
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT * n
    line_cover, ratio = dup_chars / total if total else 0.0, symbols / n if n else 0.0
    kept = not failed and all(cover.get(k, 0.0) <= most for k, most in NGRAMS.items()) and line_cover <= MAX_LINE_CHARS
    return {"n_words": n, "word_chars": total, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "ngram_cover": list(cover.items()), "line_cover": line_cover, "symbol_ratio": ratio, "base_failed": failed, "kept": bool(kept)}


def hash_of(word: bytes) -> int:
    return int.from_bytes(word[:8], "little") ^ (hash(word) & 0xFFFFFFFFFFFFFFFF)


def quality(text: Column) -> Column:
    """A struct of the measures for each text."""

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([measure(x.as_py()) for x in texts], _TYPE)

    return run(text.cast("string"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the measures, base_failed, kept.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. A text fails the base with fewer than 20 words or
    with more than 30 % of its words in repeated windows of eight. It is kept if it also stays
    within the largest shares of characters in repeated n-grams and lines; symbols a word are
    measured and don't count.
    Null texts have no words and so fail; null doc_ids and repeated rows pass through; an
    empty table gives no rows; further columns are not read.
    """
    return docs.select("doc_id", quality(F.col("text")).alias("_q")).select("doc_id", "_q.*")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all columns, whatever their names.

    Null and empty texts have no words and go; null doc_ids and repeated rows are judged one by one
    by their texts; an empty table gives no rows.
    """
    return docs.select(carried(docs).alias("_row"), quality(F.col("text")).alias("_q")).where("_q.kept").select("_row.*")


def flat(docs: DataFrame) -> DataFrame:
    """``quality_rules`` with a column cover_n for each n-gram length in place of the map."""
    covers = [F.coalesce(F.col("ngram_cover")[n], F.lit(0.0)).alias(f"cover_{n}") for n in sorted(NGRAMS)]
    return quality_rules(docs).select("*", *covers).drop("ngram_cover")


def oracle() -> str:
    """DuckDB SQL for doc_id, the base columns, the covers, symbol_ratio, base_failed and kept."""
    covers = ", ".join(f"coalesce(max(chars / word_chars) FILTER (n = {n}), 0) AS cover_{n}" for n in sorted(NGRAMS))
    lengths = ", ".join(f"({n})" for n in sorted({*NGRAMS, WINDOW}))
    shares = ", ".join(f"({n}, {most})" for n, most in NGRAMS.items())
    blank = "[\\x20\\x09-\\x0D]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{blank}+'), lambda x: x <> '') AS w FROM d),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
n(n) AS (VALUES {lengths}),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram, unnest(range(1, len(w) - n + 2)) AS i FROM w, n WHERE len(w) >= n),
h AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, gram) AS seen FROM g),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS pos FROM h WHERE seen > 1),
p AS (SELECT doc_id, unnest(list_transform(w, lambda x: length(x))) AS size, unnest(range(1, len(w) + 1)) AS pos FROM w),
cover AS (SELECT doc_id, n, count(*) AS words, sum(size) AS chars FROM c JOIN p USING (doc_id, pos) GROUP BY doc_id, n),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, line, count(*) - 1 AS again FROM l WHERE regexp_replace(line, '{blank}', '', 'g') <> '' GROUP BY doc_id, line),
lines AS (SELECT doc_id, sum(again) AS n_dup_lines, sum(again * length(regexp_replace(line, '{blank}', '', 'g'))) AS chars FROM m GROUP BY doc_id),
share(n, most) AS (VALUES {shares}),
over AS (SELECT DISTINCT doc_id FROM cover JOIN share USING (n) JOIN b USING (doc_id) WHERE chars / word_chars > CAST(most AS DOUBLE)),
a AS (
  SELECT b.*, CAST(coalesce(lines.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.words, 0) AS BIGINT) AS n_repeat_words,
    CASE WHEN word_chars > 0 THEN coalesce(lines.chars, 0) / word_chars ELSE 0 END AS line_cover, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio
    , cs.* EXCLUDE (doc_id)
  FROM b LEFT JOIN lines USING (doc_id) LEFT JOIN (SELECT doc_id, words FROM cover WHERE n = {WINDOW}) r USING (doc_id)
  JOIN (SELECT doc_id, {covers} FROM b LEFT JOIN cover USING (doc_id) GROUP BY doc_id) cs ON cs.doc_id = b.doc_id
),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND line_cover <= {MAX_LINE_CHARS} AND doc_id NOT IN (SELECT doc_id FROM over) AS kept FROM f"""
