"""Column functions on texts: tokens, phrases, snippets, import statements."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters with a diacritic and their base letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: What separates tokens.
SEPARATOR = r"[^\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    Aliases alone don't do that: a filter on a column is pushed below the projection with the
    column's whole expression in each place.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def fold(text: Column) -> Column:
    """Lower case without diacritics; texts of ASCII characters alone need no translation."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.when(is_ascii(low), low).otherwise(F.translate(low, ACCENTED, PLAIN)))


def token_text(text: Column) -> Column:
    """All tokens with two blanks before, between and behind them: two phrases in a row share none."""
    plain = lambda low: F.when(is_ascii(low), F.regexp_replace(low, "[^a-z0-9]+", "  ")).otherwise(F.regexp_replace(low, SEPARATOR, "  "))
    return F.concat(F.lit("  "), F.trim(let(fold(text), plain)), F.lit("  "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), SEPARATOR), lambda t: t != "")


def _times(text: Column, part: str) -> Column:
    """How often a part stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def token_count(text: Column) -> Column:
    """Tokens of a ``token_text``."""
    return F.when(F.length(text) <= 4, F.lit(0).cast("long")).otherwise(_times(text, "  ") - 1)


def query_tokens(query: str) -> list[str]:
    """The tokens of a query phrase; operators and quotes in it have no meaning."""
    folded = "".join(PLAIN[ACCENTED.index(c)] if c in ACCENTED else c for c in query.lower())
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split()


def phrase_count(text: Column, phrase: list[str]) -> Column:
    """How often the tokens stand next to one another in a ``token_text``; overlaps count."""
    if not phrase:
        return F.lit(0).cast("long")
    if any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase))):  # it can overlap itself
        rest = "".join(f"  {t}" for t in phrase[1:])
        return F.regexp_count(text, F.lit(f"(?<= ){phrase[0]}(?={rest} )")).cast("long")
    return _times(text, f" {'  '.join(phrase)} ")


def line_snippets(content: Column, needle: str, context: int = 3) -> Column:
    """For each line with the needle, in any case: line (from 1), content, context_before, context_after."""
    empty = F.array().cast("array<struct<line:int,content:string,context_before:array<string>,context_after:array<string>>>")
    if not needle:
        return empty
    lines = F.split(content, "\n", -1)
    at = F.filter(F.transform(lines, lambda line, i: F.when(F.contains(F.lower(line), F.lit(needle.lower())), i)), lambda i: i.isNotNull())
    before = lambda i: F.slice(lines, F.greatest(i - context, F.lit(0)) + 1, F.least(i, F.lit(context)))
    found = F.transform(
        at,
        lambda i: F.struct(
            (i + 1).cast("int").alias("line"),
            F.get(lines, i).alias("content"),
            before(i).alias("context_before"),
            F.slice(lines, i + 2, F.lit(context)).alias("context_after"),
        ),
    )
    return F.when(F.length(F.coalesce(content, F.lit(""))) > 0, found).otherwise(empty)


def char_snippet(content: Column, needle: str, radius: int = 60) -> Column:
    """The needle with ``radius`` characters on either side, cut ends marked; without it the beginning."""
    compact = F.regexp_replace(content, r"\s+", " ")
    at = F.locate(needle.lower(), F.lower(compact)) - 1
    start, end = F.greatest(at - radius, F.lit(0)), F.least(at + len(needle) + radius, F.length(compact))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(compact, start + 1, end - start)), F.when(end < F.length(compact), "…").otherwise(""))
    head = F.when(F.length(compact) <= 2 * radius, compact).otherwise(F.concat(F.rtrim(F.substring(compact, 1, 2 * radius)), F.lit("…")))
    return F.when(at < 0, head).otherwise(cut)


#: Tokens of a marked snippet, and what a sentence that begins a text, or one within it, adds to a window's score.
SNIPPET_TOKENS, FIRST_SENTENCE, SENTENCE = 32, 120, 100


def token_snippet(content: Column, phrase: list[str], opening: str = "<mark>", closing: str = "</mark>", ellipsis: str = "...", size: int = SNIPPET_TOKENS) -> Column:
    """The window of ``size`` tokens that shows a phrase best, with each place of the phrase marked.

    A window counts 1000 for the phrase and one more for each further place. One with its places in the
    middle is tried for each place, and one from the beginning of the place's sentence on, which counts
    more; of equal ones the first wins. Places that overlap are marked as one. A text without the
    phrase shows its beginning.
    """
    word, many = r"[\p{L}\p{N}]+", len(phrase)
    found = F.struct(F.regexp_extract_all(content, F.lit(word), F.lit(0)).alias("tokens"), F.split(content, word, -1).alias("gaps"))

    def places(x: Column) -> Column:
        folded, n = F.transform(x["tokens"], fold), F.size(x["tokens"])
        here = let(folded, lambda f: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(f, i + 1, F.lit(many)), " ") == " ".join(phrase))) if many else F.array().cast("array<int>")
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | F.get(x["gaps"], i).rlike(r"[.:][ \t\n\r]+$"))
        return F.struct(x["tokens"].alias("tokens"), x["gaps"].alias("gaps"), here.alias("at"), begins.alias("begins"), n.alias("n"))

    def window(x: Column) -> Column:
        inside = lambda low: F.filter(x["at"], lambda o: (o >= low) & (o < low + size))

        def middle(io: Column) -> Column:
            # C divides towards zero
            left = let(F.lit(size) - (F.array_max(inside(io)) + many - io), lambda d: F.when(d < 0, -F.floor(-d / 2)).otherwise(F.floor(d / 2)))
            return F.struct((F.size(inside(io)) + 999).alias("score"), (-2 * io).alias("order"), F.greatest(F.lit(0), F.least(io - left, x["n"] - size)).cast("int").alias("start"))

        def sentence(io: Column) -> Column:
            begin = F.array_max(F.filter(x["begins"], lambda b: b <= io))
            score = let(begin, lambda b: F.struct(let(F.size(inside(b)), lambda k: F.when(k > 0, k + 999).otherwise(0) + F.when(b == 0, FIRST_SENTENCE).otherwise(SENTENCE)).alias("score"), (-2 * io - 1).alias("order"), b.alias("start")))
            return F.when((x["n"] > size) & (begin < io), score)

        tried = F.array_compact(F.flatten(F.transform(x["at"], lambda io: F.array(middle(io), sentence(io)))))
        return F.coalesce(F.array_max(tried)["start"], F.lit(0))

    def shown(x: Column, start: Column) -> Column:
        first = F.filter(x["at"], lambda o: ~F.exists(x["at"], lambda p: (p < o) & (o < p + many)))
        last = F.transform(F.filter(x["at"], lambda o: ~F.exists(x["at"], lambda p: (o < p) & (p < o + many))), lambda o: o + many - 1)
        marks = F.filter(F.arrays_zip(first.alias("low"), last.alias("high")), lambda m: m["low"] >= start)
        end = F.least(start + size, x["n"]) - 1

        def token(i: Column, m: Column) -> Column:
            gap = F.when(i > start, F.get(x["gaps"], i)).otherwise(F.when(start > 0, F.lit(ellipsis)).otherwise(F.get(x["gaps"], F.lit(0))))
            opens = F.exists(m, lambda y: y["low"] == i)
            closes = F.exists(m, lambda y: (y["low"] <= i) & (y["high"] >= i) & ((y["high"] == i) | (i == end)))
            return F.concat(gap, F.when(opens, opening).otherwise(""), F.get(x["tokens"], i), F.when(closes, closing).otherwise(""))

        body = let(marks, lambda m: F.array_join(F.transform(F.sequence(start, end), lambda i: token(i, m)), ""))
        return F.concat(body, F.when(end >= x["n"] - 1, F.get(x["gaps"], x["n"])).otherwise(ellipsis))

    def all_of(x: Column) -> Column:
        return let(places(x), lambda y: let(window(y), lambda start: shown(y, start)))

    return let(found, lambda x: F.when(F.size(x["tokens"]) > 0, all_of(x)).otherwise(content))


# Patterns of import and export statements, of dynamic imports and of require calls.
IMPORT = r"""(?:import|export)\s+[^\n;'"`]*?from\s+["'`](.+?)["'`]"""
DYNAMIC_IMPORT = r"""import\((?:[^'"`]*?)["'`](.+?)["'`]\)"""
REQUIRE = r"""require\((?:[^'"`]*?)["'`](.+?)["'`]\)"""


def dependencies(source: Column) -> Column:
    """The modules that a source names, without repeats, sorted."""
    found = F.concat(*[F.regexp_extract_all(source, F.lit(p), 1) for p in (IMPORT, DYNAMIC_IMPORT, REQUIRE)])
    return F.array_sort(F.filter(F.array_distinct(found), lambda d: d != ""))


def line_at(content: Column, line: Column) -> Column:
    """The trimmed line of that number, from 1; none: empty."""
    lines = F.split(content, "\n", -1)
    return F.when(line >= 1, F.trim(F.coalesce(F.get(lines, line - 1), F.lit("")))).otherwise(F.lit(""))


def line_of_offset(content: Column, offset: Column) -> Column:
    """The number, from 1, of the line that holds the character at ``offset``, from 0."""
    return F.regexp_count(F.substring(content, F.lit(1), offset), F.lit("\n")) + 1
