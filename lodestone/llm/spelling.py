"""Spelling variants by anagram hashing.

The key of a word is the sum of a power of each of its letters, so it doesn't depend on their order. A
word with one letter more has a key that is larger by that letter's value, and one with another
letter in place of one has a key that differs by an exchange value. Each word therefore stands at
its own key and, for each of its letters, at its key without that letter: an added or removed letter
makes a whole key meet a reduced one, an exchange makes two reduced ones meet. What meets is
verified in the order of its letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged, written

LETTERS = "A-Za-zÀ-ÿ"
#: Letters of a word and occurrences at least; how often as frequent its form is at least; one in so many runs loses a letter.
LEAST, OCCURRENCES, RATIO, DIVISOR = 7, 2, 10, 31
#: The power of letters; keys are taken modulo a prime, so that no word is too long for them.
POWER, PRIME = 5, (1 << 61) - 1
#: Keys with more rows than this are met by the order of the remaining letters too.
SMALL = 64
#: Such keys that are marked by a broadcast; more are marked by a join.
BROADCAST = 200_000
#: Words of more letters are compared letter by letter.
LONG = 100


def occurrences(docs: DataFrame) -> DataFrame:
    """(word), once for each occurrence: runs of at least LEAST letters, A-Z lower-cased, one in DIVISOR without a letter."""
    pattern = f"(?<![{LETTERS}])[{LETTERS}]{{{LEAST},}}"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(pattern), F.lit(0))).alias("_run"))
    low = F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", UPPER, LOWER)).otherwise(F.col("_run"))
    hashed = runs.select("_id", low.alias("_run")).select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = F.pmod("_h", F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    return hashed.select(F.when(F.col("_h") % DIVISOR == 0, cut).otherwise(F.col("_run")).alias("word"))


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of words of LEAST letters or more that occur at least OCCURRENCES times."""
    counted = occurrences(docs).where(F.char_length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= OCCURRENCES)


def value(letter: Column) -> Column:
    """The anagram value of one letter."""
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def anagram_key(word: Column) -> Column:
    """The sum of the values of a word's letters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: (total + value(c)) % PRIME)


def one_apart(a: Column, b: Column) -> Column:
    """Whether a is b with one letter more, or with another letter in one place; neither is shorter than the other otherwise.

    An edit distance takes the square of the length, so long words are compared letter by letter.
    """
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.isNull() | y.isNull() | (x != y))
    at = F.array_position(differ, True).cast("int")
    rest = F.when(F.char_length(a) == F.char_length(b), F.substring(b, at + 1, F.char_length(b))).otherwise(F.substring(b, at, F.char_length(b)))
    compared = (at > 0) & (F.substring(a, at + 1, F.char_length(a)) == rest)
    return F.when(F.char_length(a) > LONG, compared).otherwise(F.levenshtein(a, b, 1) == 1)


def near_pairs(words: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, n_a, b, n_b) of words that differ by exactly one inserted, deleted or replaced letter, each pair once.

    A key that many words share, as words of the same syllables do, isn't left to all pairs
    of them: there a word stands once for each place of the missing letter, at a hash of what remains in
    order, where at most one word for each letter of the alphabet can meet it.
    """
    keyed = written(words.select("word", "n", anagram_key(F.col("word")).alias("whole")))
    letters = F.concat(F.array(F.lit("")), F.filter(F.array_distinct(F.split("word", "")), lambda c: c != ""))
    rows = keyed.select("word", "n", "whole", F.explode(letters).alias("missing")).select(F.pmod(F.col("whole") - value(F.col("missing")), F.lit(PRIME)).alias("key"), "word", "n", "missing")
    hot = staged(rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > small).select("key"))
    mark = F.broadcast(hot) if hot.count() <= BROADCAST else hot

    def met(rows: DataFrame, *on: str) -> DataFrame:
        # both sides are one and the same, so that they are shuffled once
        a, b = rows.alias("a"), rows.alias("b")
        x, y = F.col("a.word"), F.col("b.word")
        longer = F.char_length(x) - F.char_length(y)
        pairs = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]).where((longer == 1) | ((longer == 0) & (x < y)))
        return pairs.where(one_apart(x, y)).select(x.alias("a"), F.col("a.n").alias("n_a"), y.alias("b"), F.col("b.n").alias("n_b"))

    few = met(rows.join(mark, "key", "left_anti").select("key", "word", "n"), "key")
    places = F.filter(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring("word", i, F.lit(1)) == F.col("missing"))
    rest = F.transform(places, lambda i: F.xxhash64(F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.char_length("word")))))
    orders = F.when(F.col("missing") == "", F.array(F.xxhash64("word"))).otherwise(F.array_distinct(rest))
    many = rows.join(mark, "key").select("key", "word", "n", F.explode(orders).alias("order"))
    return few.union(met(many, "key", "order"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form): forms followed to the last.

    Each step of a chain is RATIO times as frequent as the one before, so a chain has at most 19
    words; five doublings reach the end of any, and fewer are made where nothing changes.
    """
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        above = now.select(F.col("word").alias("_at"), F.col("root").alias("_above"))
        grown = staged(now.join(above, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_above", "root").alias("root"), F.col("_above").isNotNull().alias("_grew")))
        now = grown.select("word", "root")
        if grown.where("_grew").isEmpty():
            return now


def variants(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    The form of a word is its near word of largest n (ties: the smallest in code-point order) if
    that is at least RATIO times the word's own n, else null; root follows forms to the last, and is the
    word itself where there is none. n_near counts near words. Null and empty texts have no words,
    a null doc_id counts as an empty one, repeated rows are occurrences of their own, texts
    and words may have any length; an empty table gives no rows, and further columns are not read.
    """
    counted = written(words(docs.select("doc_id", "text")))
    pairs = near_pairs(counted, small)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("near")).alias("_near"))
    both = both.union(pairs.select("b", F.struct((-F.col("n_a")).alias("n"), F.col("a").alias("near"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("_near").alias("_best"))
    found = counted.join(best, "word", "left")
    is_form = -F.col("_best.n") >= RATIO * F.col("n")
    of = written(found.select("word", F.when(is_form, F.col("_best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("_best.n")).alias("form_n")))
    last = roots(of.where("form is not null").select("word", "form"))
    return of.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL: CRC-32 by its table, near words by what remains when one letter goes."""
    codes = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END))"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS run FROM documents) WHERE length(run) >= {LEAST} GROUP BY ALL),
b AS (SELECT run, k, {codes} AS bytes FROM (SELECT run, k, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM r)),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM b, crc),
o AS (SELECT CASE WHEN h % {DIVISOR} = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM o WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {OCCURRENCES}),
d AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
g AS (SELECT word, count(*) AS n_near, min(ROW(-near_n, near)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {RATIO} * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= {RATIO} * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN g USING (word)),
c AS (SELECT word, form AS last FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.last = f.word WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.last FROM c JOIN f ON c.last = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(e.last, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e ON f.word = e.word"""
