"""Cross-tokenizer alignment: two segmentations of the same bytes, cut where both have a token's end.

Texts of an Arrow batch stand end to end with the byte offsets of their documents. The ends of all A
tokens and of all B tokens are counted at their byte offsets at once; where both have one, a group
ends. Between two ends of either kind one A and one B token overlap, so the links of a
group are the ends in it. Sums over the whole batch, taken at the documents' offsets, give back what
each document has.

How many documents hold an id pair is a count over the whole corpus. A batch is a block that has
each of its pairs once, so what is shuffled, both to be counted and to bring the counts back, is
one row for each pair of a block and not for each pair of a document.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stretches, written

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once; a longer text goes alone.
STRETCH = 2 << 20
#: Segments whose ids a worker remembers at most, before a stretch, and how many of them it then keeps.
REMEMBERED, KEPT = 400_000, 200_000
#: Segments that are encoded as one text.
JOINED = 2000
#: Ids of A and B are one number: A times this and B.
B_IDS = 1 << 20
SPACE = "▁"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TokensA:
    """A byte-level vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        of, vocabulary = byte_level(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class TokensB:
    """A piece vocabulary with byte fallback. Texts begin with the space that the tokenizer adds itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for k in range(self.tokenizer.get_piece_size()):
            piece = self.tokenizer.id_to_piece(k)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.tokenizer.is_byte(k) else piece.replace(SPACE, " ").encode())
        # no piece holds a space behind another character, so none spans the beginning of a segment
        self.cut = not any(" " in piece.lstrip(b" ").decode("utf-8", "replace") for piece in self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode([x[1:] for x in texts], num_threads=1)


class Side:
    """Ids of remembered segments in one array, and what they need to be gathered by a segment's number."""

    def __init__(self, tokens: TokensA | TokensB) -> None:
        self.tokens = tokens
        self.lengths = np.array([len(x) for x in tokens.bytes], np.int64)
        self.sizes, self.starts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.right = np.zeros(0, bool)

    def encode(self, segments: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments end to end, and how many each has.

        Plain segments, from one space to the next, are encoded JOINED at a time: neither tokenizer
        has a token across the beginning of one, and the tokens' lengths tell which are whose. Where they
        don't add up, as a token's bytes aren't the text's, each is encoded on its own.
        """
        ids, sizes = [], np.zeros(len(segments), np.int64)
        length = pc.binary_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(segments), JOINED):
            some, size = segments.slice(at, JOINED), length[at : at + JOINED]
            if plain[at : at + JOINED].all():
                joined = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), "")[0].as_py()
                found = np.array(self.tokens.encode([joined])[0], np.int32)
                ends, wanted = np.cumsum(self.lengths[found]), np.cumsum(size)
                last = np.searchsorted(ends, wanted)
                if len(found) and ends[-1] == wanted[-1] and (ends[last] == wanted).all():
                    ids.append(found)
                    sizes[at : at + JOINED] = np.diff(last + 1, prepend=0)
                    continue
            each = self.tokens.encode(some.to_pylist())
            ids += [np.array(x, np.int32) for x in each]
            sizes[at : at + JOINED] = [len(x) for x in each]
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), sizes

    def learn(self, segments: pa.Array, plain: np.ndarray) -> None:
        """Remember new segments behind the others, and whether their tokens' bytes are theirs."""
        ids, sizes = self.encode(segments, plain)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
        ends = np.cumsum(sizes)
        texts = segments.to_pylist()
        joined = b"".join(map(self.tokens.bytes.__getitem__, ids.tolist()))
        at = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], ends])].tolist()
        self.right = np.concatenate([self.right, [joined[a:z] == x.encode() for a, z, x in zip(at, at[1:], texts, strict=False)]]).astype(bool)

    def keep(self, stay: np.ndarray) -> None:
        self.pool = self.pool[np.repeat(stay, self.sizes)]
        self.sizes, self.right = self.sizes[stay], self.right[stay]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def gather(self, numbers: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments end to end, and where each document's begin, with the end of the last."""
        many = self.sizes[numbers]
        after = np.concatenate([[0], np.cumsum(many)])
        ids = self.pool[np.repeat(self.starts[numbers] - after[:-1], many) + np.arange(after[-1])]
        return ids, after[np.searchsorted(owner, np.arange(docs + 1))]


#: White space that neither tokenizer may be cut before, by its first bytes in UTF-8; the set is larger than what either knows.
_WHITE = [bytes([b]) for b in (*range(0x09, 0x0E), *range(0x1C, 0x21))] + [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]


class Aligner:
    """Both tokenizers, and segments that were met lately with their ids."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = Side(TokensA(a)), Side(TokensB(b))
        self.segments, self.seen = pa.array([], pa.string()), np.zeros(0, np.int64)
        digits = [b"%d" % k for k in range(max(len(self.a.lengths), len(self.b.lengths)))]
        width = len(digits[-1])
        self.digits = np.frombuffer(b"".join(x.ljust(width) for x in digits), np.uint8).reshape(-1, width)
        self.n_digits = np.array([len(x) for x in digits], np.int64)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where segments begin: at each document, and before each space between what is no space and what is no white space."""
        if not self.b.tokens.cut:
            return offsets[:-1]
        n = len(data)
        at = np.flatnonzero((data[1:] == 0x20) & (data[:-1] != 0x20)) + 1
        at = at[at + 1 < n]
        for white in _WHITE:
            hit = np.ones(len(at), bool)
            for k, byte in enumerate(white):
                hit &= data[np.minimum(at + 1 + k, n - 1)] == byte
            at = at[~hit] if hit.any() else at
        is_cut = np.zeros(n + 1, bool)
        is_cut[at] = True
        is_cut[offsets] = True  # empty documents share an offset
        return np.flatnonzero(is_cut[:-1])

    def numbers(self, parts: pa.Array, plain: np.ndarray) -> np.ndarray:
        """The number of each different segment."""
        if len(self.segments) > REMEMBERED:
            stay = np.zeros(len(self.seen), bool)
            stay[np.argsort(-self.seen, kind="stable")[:KEPT]] = True
            self.segments, self.seen = self.segments.filter(pa.array(stay)), self.seen[stay]
            self.a.keep(stay)
            self.b.keep(stay)
        at = pc.index_in(parts, value_set=self.segments)
        unknown = pc.is_null(at)
        found = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if len(new := parts.filter(unknown)):
            mask = unknown.to_numpy(zero_copy_only=False)
            # plain ones first, so that they are encoded together
            order = np.argsort(~plain[mask], kind="stable")
            new = new.take(pa.array(order))
            number = np.empty(len(order), np.int64)
            number[order] = len(self.segments) + np.arange(len(order))
            found[mask] = number
            self.a.learn(new, plain[mask][order])
            self.b.learn(new, plain[mask][order])
            self.segments = pa.concat_arrays([self.segments, new])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.seen[found] += 1
        return found

    def batch(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """What a stretch of texts has: by document n_a, n_b, n_groups, n_links, sha, and links as numbers of pairs.

        ``pairs`` are the block's different pairs, and each document has a stretch of ``pair``, places
        in them, each once, and of ``times``, the document's links with that pair.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
        docs = len(texts)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, docs], texts), "")[0].as_py().encode() if docs else b"", np.uint8)
        begins = self.cuts(data, offsets) if len(data) else np.zeros(0, np.int64)
        ends = np.concatenate([begins[1:], [len(data)]]) if len(begins) else begins
        owner = np.searchsorted(offsets, begins, side="right") - 1
        parts = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(np.concatenate([begins, [len(data)]]).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        # a segment is plain if it is a space and then no white space, which the cut before it says unless it is a text's first, and ends in no space
        second, last = (data[x] if len(data) else data for x in (np.minimum(begins + 1, len(data) - 1), ends - 1))
        is_first = np.isin(begins, offsets)
        safe = ((second > 0x20) & (second < 0x7F)) | ((second >= 0xC3) & (second < 0xE1))
        plain = (ends - begins > 1) & (last != 0x20) & (safe | ~is_first) & self.b.tokens.cut
        code = np.asarray(parts.indices)
        of_code = np.zeros(len(parts.dictionary), bool)
        of_code[code] = plain
        numbers = self.numbers(parts.dictionary.cast(pa.string()), of_code)[code] if len(begins) else np.zeros(0, np.int64)

        # a document whose tokens' bytes aren't its text has no tokens
        wrong = np.zeros(docs, bool)
        wrong[owner[~(self.a.right[numbers] & self.b.right[numbers])]] = True
        stay = ~wrong[owner]
        numbers, owner = numbers[stay], owner[stay]
        sizes = np.where(wrong, 0, sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        (a, first_a), (b, first_b) = self.a.gather(numbers, owner, docs), self.b.gather(numbers, owner, docs)
        return self.aligned(a, first_a, b, first_b, offsets) | {"docs": docs}

    def aligned(self, a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Cut where ends of both meet, and sum up by document."""
        size = int(offsets[-1])
        end_a, end_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        at_a, at_b = (np.bincount(x, minlength=size + 1) for x in (end_a, end_b))
        both, either = np.cumsum(at_a & at_b), np.cumsum(at_a | at_b)
        n_groups, n_links = (np.diff(x[offsets]) for x in (both, either))
        group_a, group_b = (both[x - 1] for x in (end_a, end_b))  # group ends before a token's own

        # each end of either kind is the end of one overlap, in the tokens that have begun before it
        link = np.flatnonzero(at_a | at_b)
        before_a, before_b = np.cumsum(at_a)[link - 1], np.cumsum(at_b)[link - 1]
        pair = a[before_a].astype(np.int64) * B_IDS + b[before_b]
        pairs, place = np.unique(pair, return_inverse=True)
        owner = np.repeat(np.arange(len(n_links)), n_links)
        cell, times = np.unique(owner * max(len(pairs), 1) + place, return_counts=True)
        of_doc, pair_of = np.divmod(cell, max(len(pairs), 1))
        return {
            "n_a": np.diff(first_a), "n_b": np.diff(first_b), "n_groups": n_groups, "n_links": n_links, "sha": self.digests(a, b, group_a, group_b, first_a, first_b),
            "pairs": pairs, "held": np.bincount(pair_of, minlength=len(pairs)), "pair": pair_of, "times": times, "stretch": np.searchsorted(of_doc, np.arange(len(n_links) + 1)),
        }

    def digests(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> list[str]:
        """The hash of each document's groups, whose text is written for all documents at once."""
        groups = int(group_a[-1]) + 1 if len(a) else 0
        before_a, before_b = (np.searchsorted(g, np.arange(groups + 1)) for g in (group_a, group_b))
        place_a = np.arange(len(a)) + before_b[group_a]
        place_b = np.arange(len(b)) + before_a[group_b + 1]
        ids, sign = np.empty(len(a) + len(b), np.int32), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        sign[place_a[before_a[1:] - 1]], sign[place_b[before_b[1:] - 1]] = ord("|"), ord(";")
        width = self.n_digits[ids]
        start = np.concatenate([[0], np.cumsum(width + 1)])
        out = np.empty(start[-1], np.uint8)
        for k in range(self.digits.shape[1]):
            has = width > k
            out[start[:-1][has] + k] = self.digits[ids[has], k]
        out[start[1:] - 1] = sign
        text, cuts = memoryview(out), start[first_a + first_b].tolist()
        return [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:], strict=False)]


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(a: str, b: str) -> Aligner:
    """One for each worker process, as workers are used again."""
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Aligner(a, b)
    return _LOADED[a, b]


_LONGS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
_BLOCK = ", ".join(f"{c} array<long>" for c in _LONGS) + ", sha array<string>, pairs array<long>, held array<int>, pair array<int>, times array<int>, stretch array<int>"


def blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One row for each stretch of texts, with what ``Aligner.batch`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(*paths)
        whole = lambda x, kind: pa.ListArray.from_arrays([0, len(x)], x if isinstance(x, pa.Array) else pa.array(x, kind))
        for batch in batches:
            for part in stretches(batch, 1, STRETCH):
                found = aligner.batch(part.column(1))
                arrays = [whole(part.column(0), None), *(whole(found[c], pa.int64()) for c in _LONGS[1:]), whole(found["sha"], pa.string()), whole(found["pairs"], pa.int64())]
                arrays += [whole(found[c], pa.int32()) for c in ("held", "pair", "times", "stretch")]
                yield pa.RecordBatch.from_arrays(arrays, [c.split(" ")[0] for c in _BLOCK.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id())


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold each id pair linked, and whether no pair of its A id is held by more."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = written(held.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.floor(F.col("pair") / B_IDS)))
    highest = counts.groupBy("a").agg(F.max("count").alias("_highest"))
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("_highest")).alias("best"))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or whose joined token bytes aren't the text's with a space before it,
    have no tokens: zeros and an empty hash. Repeated rows are documents of their own, as are rows
    without a doc_id; texts may have any length. An empty table gives no rows; further columns are
    not read.
    """
    rows = written(blocks(docs, paths or default_tokenizers()))
    counts = written(pair_counts(rows))
    asked = rows.select("block", F.posexplode("pairs").alias("at", "pair"))
    answered = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("at", (F.col("count") * 2 + F.col("best").cast("long")).alias("count"))).alias("counts"))
    joined = rows.select("block", *_LONGS, "sha", "pair", "times", "stretch").join(answered, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda c: batch.column(c)[k].values  # noqa: B023, E731
                stretch, times, pair = (value(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("stretch", "times", "pair"))
                count = np.zeros(0, np.int64)
                if (given := value("counts")) is not None:
                    at, found = (given.field(c).to_numpy(zero_copy_only=False) for c in ("at", "count"))
                    count = np.empty(len(at), np.int64)
                    count[at] = found
                sums = [np.concatenate([[0], np.cumsum(x)])[stretch] for x in ((count[pair] & 1) * times, (count[pair] >> 1) * times)]
                yield pa.RecordBatch.from_arrays([*(value(c) for c in _LONGS), *(pa.array(np.diff(x)) for x in sums), value("sha")], [*_LONGS, "n_best", "count_sum", "groups_sha256"])

    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in (*_LONGS, "n_best", "count_sum")) + ", groups_sha256 string")
