"""Packing token pieces into sequences: exact complements first, then best fit.

The plan depends only on how many pieces there are of each length, at most ``capacity`` numbers,
which is all that the driver sees. It is a list of patterns, each a multiset of lengths with the
number of sequences of that kind. Pieces get ranks within their length, and a pattern takes
ranges of ranks, so each piece works out its sequence and offset on its own. Where texts come mixed,
the order of the mix is cut into windows that are planned and numbered one after another, so each
prefix of the sequences holds a prefix of the mix, but for the order inside one window.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, staged, stretches
from .mixing import mixed

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Parts in which the pieces of one length are ranked at least, and rows of a part, about.
BUCKETS, BUCKET_ROWS = 256, 1_000_000
#: Parts of words whose ids a worker remembers at most, before a batch, and how many of them it then keeps.
REMEMBERED, KEPT = 400_000, 200_000
#: Bytes of text that are encoded at once; a longer text goes alone.
STRETCH = 2 << 20
#: Pieces of a window of the mix at least, and windows at most; positions of the mix are counted in so many steps.
WINDOW_PIECES, WINDOWS, STEPS = 1024, 64, 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: Letters of words that are encoded many at a time, and marks that may follow them.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_MARKS = ".,;:!?|#*$%&"
_SPECIAL, _SPECIAL_END = ("<|startoftext|>", "<|endoftext|>"), "oftext|>"
#: The number of the first part; the empty part and the end of a text come before.
FIRST = 2


class Ids:
    """Token ids of texts, part by part.

    The tokenizer's normaliser and splitter lower-case and never look across ASCII white space, nor
    from a letter to a mark behind it. So a text's ids are those of its words one after another,
    and those of a word in letters and then marks are those of both. Parts have numbers, and the
    ids of those that were met lately are remembered in one array; the parts themselves stay in
    Arrow, where they are looked up. New parts in letters are encoded many at a time, split at
    blanks, as the normaliser and the splitter leave them as they are; the last token of each is
    one that ends words, which tells them apart.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        #: Remembered parts by number, from FIRST on; numbers 0 and 1 are the empty part and the end of a text.
        self.parts = pa.array([], pa.string())
        #: By number: how many ids, where they begin in the pool, and how many batches had the part.
        self.sizes, self.starts, self.seen = np.array([0, 1]), np.array([0, 0]), np.zeros(FIRST, np.int64)
        self.pool = np.array([END], "<u4")

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and how many each has."""
        found = [e.ids for at in range(0, len(parts), 1000) for e in self.tokenizer.encode_batch_fast(parts[at : at + 1000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def letters(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts that are letters only."""
        all_ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), 1000):
            some = parts.slice(at, 1000)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                many = np.diff(cuts, prepend=0)
            else:
                ids, many = self.encode(some.to_pylist())
            all_ids.append(ids)
            sizes.append(many)
        return np.concatenate(all_ids), np.concatenate(sizes)

    def learn(self, parts: pa.Array) -> np.ndarray:
        """Remember the ids of new parts, and give the parts numbers."""
        plain = pc.equal(pc.binary_length(pc.utf8_ltrim(parts, characters=_LETTERS)), 0)
        some, other = parts.filter(plain), parts.filter(pc.invert(plain))
        (a, many_a), (b, many_b) = self.letters(some), self.encode(other.to_pylist())
        sizes, first = np.concatenate([many_a, many_b]), len(self.sizes)
        self.parts = pa.concat_arrays([self.parts, some, other])
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes, self.seen = np.concatenate([self.sizes, sizes]), np.concatenate([self.seen, np.zeros(len(sizes), np.int64)])
        self.pool = np.concatenate([self.pool, a, b])
        is_plain = plain.to_numpy(zero_copy_only=False)
        return first + np.where(is_plain, np.cumsum(is_plain) - 1, len(some) + np.cumsum(~is_plain) - 1)

    def forget(self) -> None:
        """Keep the KEPT parts that most batches had."""
        stay = np.zeros(len(self.seen), bool)
        stay[np.argsort(-self.seen[FIRST:], kind="stable")[:KEPT] + FIRST] = True
        stay[:FIRST] = True
        self.parts = self.parts.filter(pa.array(stay[FIRST:]))
        self.pool = self.pool[np.repeat(stay, self.sizes)]
        self.sizes, self.seen = self.sizes[stay], self.seen[stay]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, parts: pa.Array) -> np.ndarray:
        """Numbers of different parts."""
        if len(self.parts) > REMEMBERED:
            self.forget()
        at = pc.index_in(parts, value_set=self.parts)
        found = pc.fill_null(at, -FIRST).to_numpy().astype(np.int64) + FIRST
        found[pc.equal(parts, "").to_numpy(zero_copy_only=False)] = 0
        unknown = pc.and_(pc.is_null(at), pc.not_equal(parts, ""))
        if len(new := parts.filter(unknown)):
            found[unknown.to_numpy(zero_copy_only=False)] = self.learn(new)
        self.seen[found] += 1
        return found

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each followed by END, and where each text begins, with the end of the last.

        Words and parts are numbered in Arrow, so each different part of a batch is looked up
        once; the ids of all parts are then gathered by number.
        """
        texts = pc.fill_null(texts, "")
        lower = pc.ascii_lower(texts)
        if pc.any(pc.match_substring(lower, _SPECIAL_END)).as_py():  # these are special before they are lower-cased
            lower = pc.if_else(pc.or_(*[pc.match_substring(lower, x) for x in _SPECIAL]), texts, lower)
        lists = pc.ascii_split_whitespace(lower)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        cores, marks = pc.ascii_rtrim(words, characters=_MARKS), pc.utf8_ltrim(words, characters=_LETTERS)
        both = pc.and_(pc.equal(pc.add(pc.binary_length(cores), pc.binary_length(marks)), pc.binary_length(words)), pc.greater(pc.binary_length(cores), 0))
        parts = pa.concat_arrays([pc.if_else(both, cores, words), pc.if_else(both, marks, "")]).dictionary_encode()
        of_word = self.of(parts.dictionary.cast(pa.string()))[np.asarray(parts.indices)].reshape(2, -1).T

        ends = np.asarray(lists.offsets, np.int64)[1:] - lists.offsets[0].as_py()
        numbers = np.insert(of_word[np.asarray(coded.indices)].reshape(-1), 2 * ends, FIRST - 1)  # an END behind each text
        many = self.sizes[numbers]
        after = np.concatenate([[0], np.cumsum(many)])
        ids = self.pool[np.repeat(self.starts[numbers] - after[:-1], many) + np.arange(after[-1])]
        return ids, np.concatenate([[0], after[2 * ends + np.arange(1, len(ends) + 1)]])


_LOADED: dict[str, Ids] = {}


def loaded(path: str) -> Ids:
    """One for each worker process, as workers are used again."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, sources: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut only beyond capacity.

    Also _doc, a number of the row, and with ``sources`` its source.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = loaded(path)
        for batch in batches:
            for part in stretches(batch, 1, STRETCH):
                all_ids, begins = ids.batch(part.column(1))
                many = -(-np.diff(begins) // capacity)
                of = np.repeat(np.arange(len(many)), many)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                low = begins[of] + start
                high = np.minimum(low + capacity, begins[of + 1])
                raw = memoryview(all_ids.astype("<u4", copy=False)).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(low.tolist(), high.tolist(), strict=True)), np.int64, len(of))
                arrays = [part.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(high - low), pa.array(crc)]
                yield pa.RecordBatch.from_arrays([*arrays, *(part.column(c).take(pa.array(of)) for c in more)], ["doc_id", "piece", "start", "length", "ids_crc32", *more])

    more = ["_doc", *(["source"] if sources else [])]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_doc"), *([F.col("source").cast("string").alias("source")] if sources else []))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _doc long" + (", source string" if sources else ""))


class Lengths:
    """How many pieces of each length are left, and the lengths and their sums as sets of bits."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, [0] * (capacity + 1)
        self.have = self.mirrored = 0
        for x, n in counts.items():
            self.left[x] = n
            self.have |= 1 << x
            self.mirrored |= 1 << (capacity - x)
        self.sums_mirrored, self.stale = 0, True

    def take(self, lengths: list[int]) -> int:
        """Use up a pattern as often as its parts last."""
        times = Counter(lengths)
        n = min(self.left[x] // k for x, k in times.items())
        for x, k in times.items():
            self.left[x] -= n * k
            if not self.left[x]:
                self.have ^= 1 << x
                self.mirrored ^= 1 << (self.capacity - x)
                self.stale = True
        return n

    def sums(self) -> None:
        """Index all sums of two lengths up to capacity; what is gone since makes it too large, never too small."""
        found, rest = 0, self.have
        while rest:
            x = rest.bit_length() - 1
            found |= self.have << x
            rest ^= 1 << x
        found &= (2 << self.capacity) - 1
        self.sums_mirrored = int(f"{found:0{self.capacity + 1}b}"[::-1], 2)
        self.stale = False

    def pair(self, gap: int, spent: Counter) -> tuple[int, int] | None:
        """Two lengths that add up to gap, the longer as long as can be."""
        if gap < 2:
            return None
        have, mirrored = self.have, self.mirrored
        for x, k in spent.items():
            if 0 < self.left[x] <= k:
                have ^= 1 << x
                mirrored ^= 1 << (self.capacity - x)
        both = have & (mirrored >> (self.capacity - gap)) & ((1 << gap) - 2)
        if gap % 2 == 0 and both >> (gap // 2) & 1 and self.left[gap // 2] - spent[gap // 2] < 2:
            both ^= 1 << (gap // 2)
        longer = both.bit_length() - 1
        return (longer, gap - longer) if both else None

    def triple(self, gap: int, most: int, spent: Counter) -> tuple[int, int, int] | None:
        """Three lengths that add up to gap, the first as long as can be and at most ``most``."""
        if not self.sums_mirrored:
            self.sums()
        below = (2 << min(gap - 2, most)) - 1 if gap > 2 else 0
        while found := self.have & (self.sums_mirrored >> (self.capacity - gap)) & below:
            first = found.bit_length() - 1
            if self.left[first] > spent[first] and (two := self.pair(gap - first, spent + Counter([first]))):
                return first, *two
            if self.stale:
                self.sums()
            else:
                below = (1 << first) - 1
        return None

    def best(self, gap: int, spent: Counter) -> int:
        """The longest length that fits, or 0."""
        have = self.have & ((2 << gap) - 1)
        while have:
            x = have.bit_length() - 1
            if self.left[x] > spent[x]:
                return x
            have ^= 1 << x
        return 0


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(sequences, lengths): every piece in exactly one sequence of at most ``capacity``.

    From the longest length down, its gap is looked up among the single lengths, the sums of
    pairs and the sums of triples that are still there; what fills it exactly is consumed as often
    as its parts last. What remains is packed by best fit, the longest piece that fits going next.
    """
    pool = Lengths(counts, capacity)
    out: list[tuple[int, list[int]]] = []

    def use(lengths: list[int]) -> bool:
        if n := pool.take(lengths):
            out.append((n, lengths))
        return n > 0

    if pool.left[capacity]:
        use([capacity])
    for length in range(capacity - 1, 0, -1):
        gap, spent = capacity - length, Counter([length])
        while pool.left[length]:
            if gap <= length and pool.left[gap] > (gap == length) and use([length, gap]):
                continue
            if (two := pool.pair(gap, spent)) and use([length, *two]):
                continue
            if not ((three := pool.triple(gap, length, spent)) and use([length, *three])):
                break
    while pool.have:
        lengths, gap, spent = [], capacity, Counter()
        while best := pool.best(gap, spent):
            many = min(gap // best, pool.left[best] - spent[best])  # as many as fit and are there
            lengths += [best] * many
            spent[best] += many
            gap -= best * many
        use(lengths)
    return out


def intervals(plan: list[tuple[int, list[int]]], first: int = 0) -> tuple[dict[int, np.ndarray], int]:
    """By length: rows (first rank, pieces a sequence, first sequence, offset), by first rank; and the sequence after the last, from ``first`` on."""
    used: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, lengths in plan:
        offset = 0
        for length, many in sorted(Counter(lengths).items(), reverse=True):
            rows.setdefault(length, []).append((used[length], many, first, offset))
            used[length] += n * many
            offset += length * many
        first += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}, first


def windows(cut: DataFrame, weights: dict[str, int], least: int = WINDOW_PIECES) -> DataFrame:
    """Add _window to pieces with _doc and source: windows of the mix of their texts, by its order, with ``least`` pieces or more."""
    order = mixed(cut.where("piece = 0").select("doc_id", "source", "_doc"), weights).select("_doc", "mix_pos")
    rows = staged(cut.join(order, "_doc"))
    size = rows.agg(F.max("mix_pos")).first()[0] or 0
    step = F.floor(F.col("mix_pos") * STEPS / F.lit(size + 1))
    counts = sorted(rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect())  # at most STEPS rows
    total, seen, starts = sum(r["n"] for r in counts), 0, []
    share = max(least, -(-total // WINDOWS))
    for r in counts:
        if seen >= share * (len(starts) + 1) and total - seen >= least:
            starts.append(-(-r["step"] * (size + 1) // STEPS))
        seen += r["n"]
    return rows.withColumn("_window", sum(((F.col("mix_pos") >= s).cast("int") for s in starts), F.lit(0)))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, buckets: int = BUCKETS, weights: dict[str, int] | None = None, least: int = WINDOW_PIECES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids end in the end id; only longer ones than ``capacity`` are cut. Null and empty texts
    are one piece of length one. Repeated rows and null doc_ids are texts like any other. An
    empty table gives no rows; further columns are not read. With the ``weights`` of a mix, sequences
    follow its order, which is worked out from doc_id and source whatever order the rows have.
    """
    cut = staged(pieces(docs, path, capacity, weights is not None))
    cut = windows(cut, weights, least) if weights else cut.withColumn("_window", F.lit(0))
    counts: dict[int, dict[int, int]] = {}
    for r in cut.groupBy("_window", "length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows a window
        counts.setdefault(r["_window"], {})[r["length"]] = r["n"]
    tables, first = [], 0
    for w in sorted(counts):
        found, first = intervals(patterns(counts[w], capacity), first)
        for length in sorted(found):
            tables.append(np.column_stack([np.full(len(found[length]), w * (capacity + 1) + length), found[length]]))
    largest = max((n for of in counts.values() for n in of.values()), default=0)
    plan = docs.sparkSession.sparkContext.broadcast(np.concatenate(tables) if tables else np.zeros((0, 5), np.int64))
    # ranks go by row numbers, as a doc_id may be null or repeated any number of times
    rows = ranked(cut, ["_window", "length"], F.pmod(F.xxhash64("_doc", "piece"), F.lit(max(buckets, largest // BUCKET_ROWS))).cast("int"), ["_doc", "piece"], "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, window = (np.asarray(batch.column(k)) for k in ("length", "_rank", "_window"))
            cell, table = window.astype(np.int64) * (capacity + 1) + length, plan.value
            low, high = (np.searchsorted(table[:, 0], cell, side=x) for x in ("left", "right"))
            while (more := high - low > 1).any():  # the last row of the cell whose first rank is not above
                middle = (low + high) // 2
                below = more & (table[np.minimum(middle, len(table) - 1), 1] <= rank)
                low, high = np.where(below, middle, low), np.where(more & ~below, middle, high)
            _, before, many, start, shift = table[low].T
            nth = rank - before
            sequence, offset = start + nth // many, shift + nth % many * length
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_window").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
