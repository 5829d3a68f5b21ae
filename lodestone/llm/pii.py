"""Personal data: patterns, and terms that the corpus shows to give a person away.

The patterns find the protected entities. Terms that stand next to an entity are counted with
it over the corpus, and with the entity's group: the domain of an address, the network of an IP,
the issuer of a card, the area of a phone number. By information theory a term t discloses e as
far as it lowers the information in e: PMI(t; e) / IC(e), with IC(e) = -log p(e), which is 1
where t never occurs without e. p(e | t) is smoothed towards p(e) by PRIOR sightings, so one
sighting counts, but for less than many: it suffices where e is rare enough. A term at or above
a threshold becomes a span of kind "term": it is generalised, or removed from a higher threshold
on.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, staged, written

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count as its context.
CONTEXT = 8
#: Sightings without the term's help that p(e | t) is smoothed by.
PRIOR = 1.0
GENERALISE, REMOVE = 0.90, 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; the local part of each @ is looked up backwards, so long runs stay linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, in code points, by kind and start."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """What is the same entity: e-mail addresses without case, numbers without their punctuation."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(_DIGIT.findall(value))}"


def group(kind: str, value: str) -> str:
    """What entities have in common: the domain, the first two numbers of an IP, the issuer's six digits, a phone number without its last seven digits."""
    if kind == "email":
        return f"email@{value.lower().rpartition('@')[2]}"
    if kind == "ip":
        return f"ip/{'.'.join(value.split('.')[:2])}"
    digits = "".join(_DIGIT.findall(value))
    return f"{kind}/{digits[:6] if kind == 'card' else digits[:-7]}"


def _key(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _words(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], list[bool]]:
    """The words of a text, and of each whether spans leave it free."""
    starts, ends = _merged(spans)
    found = [m.span() for m in _WORD.finditer(text)]
    return found, [(k := bisect_left(starts, e) - 1) < 0 or ends[k] <= s for s, e in found]


def neighbours(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The words beside each span: entity, group, context, term, start, end. What spans cover are no words."""
    words, free = _words(text, spans)
    begins, ends = [s for s, _ in words], [e for _, e in words]
    out = []
    for kind, start, end in spans:
        who, alike = _key(entity(kind, text[start:end])), _key(group(kind, text[start:end]))
        before, after = bisect_right(ends, start), bisect_left(begins, end)
        near = [words[k] for k in (*range(max(0, before - CONTEXT), before), *range(after, min(len(words), after + CONTEXT))) if free[k]]
        terms = [text[s:e].lower() for s, e in near]
        context = _key(" ".join(terms))
        out += [{"entity": who, "group": alike, "context": context, "term": _key(t), "start": s, "end": e} for t, (s, e) in zip(terms, near, strict=True) if len(t) > 2]
    return out


_NEAR = pa.list_(pa.struct([(c, pa.int64()) for c in ("entity", "group", "context", "term")]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def found(docs: DataFrame, number: Column | None = None) -> DataFrame:
    """(row, doc_id, spans, holds, near, text) of every row; holds are its entities and groups, text is null without any.

    ``number`` is a column with a different long for each row, by default one that is worked out here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, holds, near, texts = [], [], [], []
            for x in batch.column(2):
                text = x.as_py() or ""
                of = base_spans(text)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in of])
                holds.append(sorted({_key(f(k, text[s:e])) for k, s, e in of for f in (entity, group)}))
                near.append([{c: x[c] for c in ("entity", "group", "context", "term")} for x in neighbours(text, of)] if of else [])
                texts.append(text if of else None)
            columns = [pa.array(spans, _SPANS), pa.array(holds, pa.list_(pa.int64())), pa.array(near, _NEAR), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "doc_id", "spans", "holds", "near", "text"])

    number = F.monotonically_increasing_id() if number is None else number
    rows = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, spans array<struct<kind:string,start:long,end:long>>, holds array<long>, near array<struct<entity:long,group:long,context:long,term:long>>, text string")


def occurrences(rows: DataFrame) -> DataFrame:
    """(row, term, start, end) of every word of the texts that have spans, but for what spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = x.as_py()
                words, free = _words(text, [(s["kind"], s["start"], s["end"]) for s in of])
                kept = [(s, e) for (s, e), f in zip(words, free, strict=True) if f and len(text[s:e].lower()) > 2]
                columns = [[row] * len(kept), [_key(text[s:e].lower()) for s, e in kept], [s for s, _ in kept], [e for _, e in kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "term", "start", "end"])

    return rows.where("text is not null").select("row", "text", "spans").mapInArrow(run, "row long, term long, start long, end long")


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df): in how many rows each term occurs; counts leave a worker summed over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                seen: dict[str, int] = {}
                for x in batch.slice(at, 2048).column(0):
                    for w in set(_WORD.findall((x.as_py() or "").lower())):
                        seen[w] = seen.get(w, 0) + 1
                long = [(w, n) for w, n in seen.items() if len(w) > 2]
                yield pa.RecordBatch.from_arrays([pa.array([_key(w) for w, _ in long], pa.int64()), pa.array([n for _, n in long], pa.int64())], ["term", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def disclosing(near: DataFrame, docs: DataFrame, total: int, prior: float = PRIOR, threshold: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of pairs at or above the threshold; an entity is one or a group.

    Contexts are what is counted together, and rows beyond a pair's contexts are copies, which
    leave the term's frequency too.
    """
    # all pairs of a domain, and all of a common word, meet at one key of a join, which is split only if no aggregation stands right below it
    pairs = staged(near.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("row").alias("rows")))
    entities = staged(near.groupBy("entity").agg(F.count_distinct("row").alias("of_entity")))
    joined = pairs.join(entities, "entity").join(staged(document_frequency(docs)), "term")
    n = F.lit(float(max(total, 2)))
    together = F.least("contexts", "rows")
    alone = F.col("df") - F.col("rows")
    p = F.least(F.col("of_entity") / n, F.lit(0.9999))
    given = (together + prior * p) / (together + alone + prior)
    return joined.withColumn("disclosure", 1 - F.log(given) / F.log(p)).where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def sanitised(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, number: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, spans (kind, start, end, disclosure), by kind as listed, "term" last, then start.

    Offsets are code points, end exclusive. Terms are words of three characters or more that
    disclose an entity they stand within CONTEXT words of somewhere; they are spans wherever they
    occur in the rows that hold the entity, or another of the disclosed group. Null texts count as empty and have no spans; null doc_ids and
    repeated rows are rows of their own (repeats share their contexts, so they count once as proof);
    an empty table gives no rows; further columns are not read.
    """
    rows = staged(found(docs, number))
    near = rows.select("row", F.explode("near").alias("x")).select("row", "x.*").withColumn("entity", F.explode(F.array("entity", "group"))).drop("group")
    pairs = disclosing(near, docs, rows.count(), prior, generalise)
    holds = rows.select("row", F.explode("holds").alias("entity"))
    terms = occurrences(rows).join(pairs, "term").join(holds, ["row", "entity"]).groupBy("row", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    terms = terms.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("disclosure")))
    more = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:long,end:long,disclosure:double>>")), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["disclosure"].alias("disclosure")))
    return rows.join(terms, "row", "left").select("doc_id", "row", F.concat(base, more).alias("spans"))


def clean(text: str, spans: list[tuple[str, int, int, float]], remove: float = REMOVE) -> str:
    """The text with its entities and milder terms generalised to their kind, and stronger terms removed."""
    out, at = [], 0
    for kind, start, end, disclosure in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:
            continue
        out += [text[at:start], "" if kind == "term" and disclosure >= remove else f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The rows of ``docs`` with all columns, and in their texts entities and disclosing terms generalised or removed.

    Texts without spans stay as they are, null ones too. The rows are numbered in a table in the
    shared folder, so that a row that is read again has the same number.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("_number"), carried(docs).alias("_carried"), F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("_text")))
    spans = sanitised(rows.select(F.col("_number"), F.col("_doc").alias("doc_id"), F.col("_text").alias("text")), prior, generalise, F.col("_number"))
    some = spans.where(F.size("spans") > 0).select(F.col("row").alias("_number"), F.col("spans").alias("_spans"))

    @F.arrow_udf("string")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, of in zip(texts, spans.to_pylist(), strict=True):
            out.append(clean(text.as_py(), [(s["kind"], s["start"], s["end"], s["disclosure"]) for s in of], remove) if of else text.as_py())
        return pa.array(out, pa.string())

    joined = rows.join(some, "_number", "left").withColumn("_clean", run("_text", "_spans"))
    return joined.select(*[F.col("_clean").alias(c) if c.lower() == "text" else F.col("_carried").getField(c).alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (joined as kind:start:end)."""
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    rows = sanitised(docs)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sha(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
