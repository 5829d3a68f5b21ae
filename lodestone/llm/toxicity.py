"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of those of its beginnings, so rare
forms of a known stem are known. Filters of several widths run over the words, and the two
largest activations of each filter over the whole text are pooled: one hit and a second one tell
a passing word from a toxic text. A logistic layer gives the log odds. Spark counts, trains and
calibrates on every labelled row: each task goes through its own rows, and what tasks have moved is
averaged after each epoch.
"""

from __future__ import annotations

import copy
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, stretches, temporary

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (3, 4, 5, 6, 7, 8)
POOLED = 2
BATCH = 64
#: Bytes of labelled text for each task that trains, and for each block of texts that share their words.
PART, BLOCK = 16 << 20, 1 << 20
#: Bits of a hash of doc_id by which most rows without a label are left out before texts are shuffled.
BITS = 25
#: Slices of the embedding in which what tasks have moved is averaged.
SLICES = 16
#: Labelled rows from which on a fifth of them calibrates and doesn't train.
APART = 200
#: The bounds of ``sample_of``, for either class: labelled rows, and bytes of their whole texts.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 32 << 20
EPOCHS = 8
#: Words that a worker remembers, and words that are scored at once.
REMEMBERED = 300_000
CHUNK = 200_000
#: Bytes of text whose words are looked up at once; a longer text goes alone.
STRETCH = 4 << 20
STRIP = ".,;:!?\"'()[]{}|<>#*$%&-–—_"


def _buckets(texts: pa.Array, mark: bytes = b"") -> np.ndarray:
    """The bucket of each text behind a mark."""
    begun, crc = zlib.crc32(mark), zlib.crc32
    return np.array([crc(x, begun) for x in texts.cast(pa.binary()).to_pylist()], np.int64) % (BUCKETS - 1) + 1


def word_buckets(words: list[str]) -> np.ndarray:
    """A row for each word: buckets of the word and of its beginnings, 0 where there is none. Equal beginnings are hashed once."""
    bare = pc.utf8_trim(pa.array(words, pa.string()), characters=STRIP)
    length = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = np.where(length > 0, _buckets(bare), 0)
    for k, n in enumerate(PREFIXES, 1):
        begun = pc.utf8_slice_codeunits(bare, 0, n).dictionary_encode()
        of = _buckets(begun.dictionary, b"^")
        out[:, k] = np.where(length >= n, of[np.asarray(begun.indices)], 0)
    return out


class Words:
    """Numbers for words; number 0 is padding."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.buckets = np.zeros((1, 1 + len(PREFIXES)), np.int32)

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers of the words of each text, lower-cased and split at white space; different words are looked up once."""
        if not len(texts):
            return []
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.number
        if new := [w for w in distinct if w not in known]:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.buckets = np.concatenate([self.buckets, word_buckets(new)])
        ids = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        ends = np.asarray(lists.offsets, np.int64)[1:] - lists.offsets[0].as_py()
        ends = np.concatenate([[0], np.cumsum(ids > 0)])[ends]  # white space at either end leaves an empty word
        return np.split(ids[ids > 0], ends[:-1])

    def matrix(self, start: int = 0) -> np.ndarray:
        """Buckets of each word from ``start`` on, padded with 0."""
        return self.buckets[start:]


def lay(texts: list[np.ndarray], begins: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers one text after another with padding between, each text's start, and where windows may begin: ``begins`` at each text's first words, or all."""
    pad = max(WIDTHS) - 1
    sizes = np.array([len(t) for t in texts], np.int64) + pad + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    ids = np.zeros(int(sizes.sum()) + pad, np.int64)
    real = np.zeros(len(ids), bool)
    for t, s, many in zip(texts, starts, begins or map(len, texts), strict=True):
        ids[s : s + len(t)] = t
        real[s : s + many] = True
    return ids, starts, real


def largest(act: np.ndarray, starts: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(place, text, filter): the largest activations over each text's windows, and where they are. ``act`` is (filter, window), and is spent."""
    tops, places = np.zeros((POOLED, len(sizes), len(act)), np.float32), np.zeros((POOLED, len(sizes), len(act)), np.int64)
    rows = np.arange(len(act))
    for k, (start, size) in enumerate(zip(starts.tolist(), sizes, strict=True)):
        part = act[:, start : start + size]
        for m in range(POOLED if size else 0):
            at = part.argmax(axis=1)
            tops[m, k], places[m, k] = part[rows, at], start + at
            part[rows, at] = -np.inf
    return np.maximum(tops, 0), places


def embedded(embedding: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The sum of the rows of each word's buckets."""
    out = embedding.take(buckets[:, 0], axis=0)
    for k in range(1, buckets.shape[1]):
        out += embedding.take(buckets[:, k], axis=0)
    return out


class Model:
    def __init__(self, embedding: np.ndarray, filters: list[np.ndarray], biases: list[np.ndarray], dense: np.ndarray, bias: float) -> None:
        self.embedding, self.filters, self.biases, self.dense, self.bias = embedding, filters, biases, dense, bias
        self.shift, self.scale = 0.0, 1.0
        self.thresholds: dict[str, float] = {}

    def shares(self, buckets: np.ndarray) -> list[list[np.ndarray]]:
        """By width and place: each word's share of each filter's activation."""
        x = embedded(self.embedding, buckets)
        return [[x @ w[j] for j in range(len(w))] for w in self.filters]

    def pooled(self, parts: list[np.ndarray], begins: list[int], shares: list[list[np.ndarray]]) -> np.ndarray:
        """(part, place, filter): the largest and second largest activation of each filter over the windows of a part."""
        ids, starts, real = lay(parts, begins)
        n = len(ids) - max(WIDTHS) + 1
        found = []
        for share, b in zip(shares, self.biases, strict=True):
            act = sum(s[ids[j : j + n]] for j, s in enumerate(share)) + b
            act[~real[:n]] = 0
            top = np.maximum(np.maximum.reduceat(act, starts, axis=0), 0)
            size = np.diff(np.append(starts, n))
            same = act == np.repeat(top, size, axis=0)
            twice = np.add.reduceat(same, starts, axis=0, dtype=np.int64) > 1
            act[same] = 0
            second = np.maximum(np.maximum.reduceat(act, starts, axis=0), 0)
            found += [np.stack([top, np.where(twice, top, second)], axis=1)]
        return np.concatenate(found, axis=2)

    def logits(self, texts: list[np.ndarray], shares: list[list[np.ndarray]], chunk: int = CHUNK) -> np.ndarray:
        """A text's windows are pooled in parts of ``chunk`` words; the two largest of all its parts count."""
        parts, begins, of = [], [], []
        for k, t in enumerate(texts):
            for at in range(0, max(len(t), 1), chunk):
                parts.append(t[at : at + chunk + max(WIDTHS) - 1])
                begins.append(min(chunk, len(t) - at))
                of.append(k)
        best = np.zeros((len(texts), POOLED, len(WIDTHS) * FILTERS), np.float32)
        at = 0
        while at < len(parts):  # so many parts at once that they have about a chunk of words
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= chunk):
                size += len(parts[end])
                end += 1
            found = self.pooled(parts[at:end], begins[at:end], shares)
            for k, one in zip(of[at:end], found, strict=True):
                best[k] = one if not best[k].any() else np.sort(np.concatenate([best[k], one]), axis=0)[:-POOLED - 1 : -1]
            at = end
        # the dense layer has each width's largest, then its second largest
        wide = best.reshape(len(texts), POOLED, len(WIDTHS), FILTERS).transpose(0, 2, 1, 3).reshape(len(texts), -1)
        return wide @ self.dense + self.bias

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((logits - self.shift) * self.scale, -40, 40)))


def seen_in(texts: list[np.ndarray], y: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """(class, bucket): the texts of a class with a word in the bucket."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for t, v in zip(texts, y, strict=True):
        if len(t):
            seen[int(v), np.unique(buckets[np.unique(t)])] += 1
    return seen


def log_odds(seen: np.ndarray, count: np.ndarray) -> np.ndarray:
    """By bucket: how much likelier texts with it are toxic, damped; ``count`` has the texts of either class."""
    share = (seen + 1) / (count[:, None] + 2)
    odds = np.log(share[1] / share[0]) * np.minimum(1, (seen.sum(axis=0)) / 8)
    odds[0] = 0
    return odds


def begun(seen: np.ndarray, count: np.ndarray, rng: np.random.Generator) -> Model:
    """The model that training starts from; without texts of both classes, one that stays."""
    embedding = (rng.standard_normal((BUCKETS, DIM)) * 0.02).astype(np.float32)
    embedding[:, 0] = log_odds(seen, count) / 3
    embedding[0] = 0
    filters = [(rng.standard_normal((k, DIM, FILTERS)) * 0.2).astype(np.float32) for k in WIDTHS]
    for f in filters:
        f[0, 0, :] = np.abs(f[0, 0, :]) + 0.5
    biases = [np.linspace(-0.5, -2, FILTERS).astype(np.float32) for _ in WIDTHS]
    width = len(WIDTHS) * FILTERS * POOLED
    if not count.all():
        return Model(embedding, filters, biases, np.zeros(width, np.float32), -4.0)
    return Model(embedding, filters, biases, np.full(width, 0.05, np.float32), float(np.log((count[1] + 1) / (count[0] + 1)) - 0.5))


def rate_of(epoch: int, epochs: int) -> float:
    return 0.05 * (1 - epoch / epochs) + 0.005


class Training:
    """A model, and the squares that AdaGrad has summed up for each of its parameters."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.seen, self.bias_seen = [np.full(p.shape, 1e-3, np.float32) for p in self.parts()], 1e-3

    def parts(self) -> list[np.ndarray]:
        return [self.model.embedding, *self.model.filters, *self.model.biases, self.model.dense]

    def flat(self) -> list[np.ndarray]:
        """The embedding and its squares, then all else and its squares, by rows."""
        rest = np.concatenate([*(p.reshape(-1) for p in self.parts()[1:]), [np.float32(self.model.bias)]])
        squares = np.concatenate([*(p.reshape(-1) for p in self.seen[1:]), [np.float32(self.bias_seen)]])
        return [self.model.embedding, self.seen[0], rest[None, :], squares[None, :]]

    def add(self, moved: list[np.ndarray]) -> None:
        """Add what has the form of ``flat``."""
        self.model.embedding += moved[0]
        self.seen[0] += moved[1]
        for arrays, more in ((self.parts()[1:], moved[2][0]), (self.seen[1:], moved[3][0])):
            at = 0
            for p in arrays:
                p += more[at : at + p.size].reshape(p.shape)
                at += p.size
        self.model.bias += float(moved[2][0, -1])
        self.bias_seen += float(moved[3][0, -1])

    def step(self, docs: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, rate: float) -> None:
        """One step on a batch of texts; ``buckets`` has the rows of their word numbers."""
        model, sizes = self.model, [len(t) for t in docs]
        ids, starts, _ = lay(docs)
        n = len(ids) - max(WIDTHS) + 1
        present = np.zeros(len(buckets), bool)
        present[ids] = True
        own = np.flatnonzero(present)
        number = np.zeros(len(buckets), np.int64)
        number[own] = np.arange(len(own))
        inverse = number[ids]
        x = embedded(model.embedding, buckets.take(own, axis=0))
        act = np.empty((len(WIDTHS) * FILTERS, n), np.float32)
        for k, (w, b) in enumerate(zip(model.filters, model.biases, strict=True)):
            of = act[k * FILTERS : (k + 1) * FILTERS]
            of[:] = b[:, None]
            for j in range(len(w)):
                of += np.ascontiguousarray((x @ w[j]).T).take(inverse[j : j + n], axis=1)
        wide = (POOLED, len(docs), len(WIDTHS), FILTERS)
        tops, places = (a.reshape(wide).transpose(1, 2, 0, 3) for a in largest(act, starts, sizes))  # (text, width, place, filter)
        h = tops.reshape(len(docs), -1)
        p = 1 / (1 + np.exp(-np.clip(h @ model.dense + model.bias, -30, 30)))
        g = ((p - y) / len(docs)).astype(np.float32)
        gh = (g[:, None] * model.dense[None, :] * (h > 0)).reshape(tops.shape)

        def move(p: np.ndarray, g: np.ndarray, s: np.ndarray) -> None:
            s += g * g
            p -= rate * g / np.sqrt(s)

        move(model.dense, (h.T @ g + 1e-4 * model.dense).astype(np.float32), self.seen[-1])
        self.bias_seen += float(g.sum()) ** 2
        model.bias -= rate * float(g.sum()) / np.sqrt(self.bias_seen)
        gx = np.zeros_like(x)
        for k, w in enumerate(model.filters):
            gw, gb = np.zeros_like(w), np.zeros(FILTERS, np.float32)
            for m in range(POOLED):
                part = np.ascontiguousarray(gh[:, k, m])
                gb += part.sum(axis=0)
                for j in range(len(w)):
                    of = inverse[np.minimum(places[:, k, m] + j, len(inverse) - 1)]
                    gw[j] += np.einsum("nfd,nf->df", x[of], part)
                    np.add.at(gx, of.reshape(-1), (part[:, :, None] * w[j].T[None, :, :]).reshape(-1, DIM))
            move(w, gw, self.seen[1 + k])
            move(model.biases[k], gb, self.seen[1 + len(WIDTHS) + k])
        moved = np.flatnonzero(np.abs(gx).sum(axis=1))
        rows = buckets[own[moved]]
        flat, back = np.unique(rows, return_inverse=True)
        ge = np.zeros((len(flat), DIM), np.float32)
        np.add.at(ge, back.reshape(-1), np.repeat(gx[moved], rows.shape[1], axis=0))
        ge[flat == 0] = 0
        self.seen[0][flat] += ge * ge
        model.embedding[flat] -= rate * 0.5 * ge / np.sqrt(self.seen[0][flat])


def train(texts: list[str | None], labels: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> Model:
    """A model of texts in one process: the same for the same rows in the same order."""
    rng, words = np.random.default_rng(seed), Words()
    docs, y = words.texts(pa.array(texts, pa.string())), np.asarray(labels, float)
    buckets, count = words.matrix(), np.bincount(y.astype(int), minlength=2)
    training = Training(begun(seen_in(docs, y, buckets), count, rng))
    for epoch in range(epochs if count.all() else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            training.step([docs[i] for i in batch], y[batch], buckets, rate_of(epoch, epochs))
    return training.model


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, half way between the scores on either side of it."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = logits[order[k + 1]] if k + 1 < len(y) else logits[order[k]] - 1
    return float((logits[order[k]] + low) / 2)


def logits_of(model: Model, texts: list[str | None]) -> np.ndarray:
    words = Words()
    docs = words.texts(pa.array(texts, pa.string()))
    return model.logits(docs, model.shares(words.matrix()))


def fit(sample: pd.DataFrame, seed: int = 1) -> Model:
    """As ``learned``, of rows that are in this process: train on four fifths of them; calibrate on the rest, in all and by language.

    The score is 0.5 at the cut that is best over all languages, as a language is no input of it;
    ``thresholds`` has the cuts, as scores, of languages with 20 toxic rows or more.
    """
    sample = sample.sort_values("doc_id").reset_index(drop=True)
    rest = (sample.index % 5 == 0) if len(sample) >= APART else np.zeros(len(sample), bool)
    part = sample[~rest]
    model = train(part.text.tolist(), part.toxic.to_numpy(float), seed)
    held = sample[rest] if rest.any() else part
    if held.toxic.nunique() == 2:
        logits, y = logits_of(model, held.text.tolist()), held.toxic.to_numpy(float)
        model.shift = best_threshold(logits, y)
        for lang, of in held.assign(logit=logits).groupby("lang"):
            if of.toxic.sum() >= 20 and of.toxic.nunique() == 2:
                model.thresholds[str(lang)] = float(model.score(np.array([best_threshold(of.logit.to_numpy(), of.toxic.to_numpy(float))]))[0])
    return model


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from; of several of a doc_id the largest counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.where((F.col("toxic").isin(0, 1)) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> pd.DataFrame:
    """A bounded sample, for a look at ``fit``; ``scored`` learns from all rows. Of each class, whole texts in the order of a hash of doc_id, as they fit into ``rows`` and ``size`` bytes.

    Of several texts of a doc_id the one with the smallest hash counts. All of this is worked out
    before anything goes to the driver.
    """
    known = known_labels(labels).withColumn("_h", F.md5(F.col("doc_id").cast("string")))
    # some more, as there may be no text; at most 4 * rows ids are broadcast
    chosen = known.where("toxic = 1").orderBy("_h").limit(2 * rows).unionByName(known.where("toxic = 0").orderBy("_h").limit(2 * rows))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang")).where(F.octet_length("text") <= size)
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "_h").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("t")).select("doc_id", "t.text", "t.lang", "toxic", "_h")
    one, kept = staged(one), []
    left = {0: [rows, size], 1: [rows, size]}
    for _, doc, label, long in sorted(map(tuple, one.select("_h", "doc_id", "toxic", F.octet_length("text")).collect())):  # at most 4 * rows rows
        if left[label][0] and left[label][1] >= long:
            left[label] = [left[label][0] - 1, left[label][1] - long]
            kept.append((doc,))
    if not kept:
        return one.limit(0).select("doc_id", "text", "lang", "toxic").toPandas()
    return one.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long")), "doc_id").select("doc_id", "text", "lang", "toxic").toPandas()


#: Models by a digest of their sample: training is the same for the same rows.
_FITTED: dict[str, Model] = {}


def fitted(sample: pd.DataFrame) -> Model:
    """The model of a sample, kept for the next time the same sample comes."""
    sample = sample.sort_values("doc_id").reset_index(drop=True)
    digest = hashlib.sha256()
    for row in sample.itertuples(index=False):
        digest.update(repr(tuple(row)).encode("utf-8", "surrogatepass"))
    if (key := digest.hexdigest()) not in _FITTED:
        while len(_FITTED) >= 2:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[key] = fit(sample)
    return _FITTED[key]


def marked(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among the known ones, by a bitmap of hashes of fixed size, of which at most 2^19 words are broadcast.

    The more ids there are the more others pass as well; none that is known is left out.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS)
    word, bit = F.shiftright(h, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), {64 - BITS}) % 64 as int))")
    words = known.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.select("*", word, bit.alias("_bit")).join(F.broadcast(words), "_word").where("(_bits & _bit) <> 0").drop("_word", "_bit", "_bits")


BLOCKS = "ids binary, sizes binary, toxic binary, rest binary, langs array<string>, buckets binary"


def labelled_blocks(docs: DataFrame, labels: DataFrame, size: int) -> tuple[DataFrame | None, int]:
    """Every labelled row that may be learnt from, in blocks of texts by word numbers, staged, and the number of rows.

    Rows are dealt by doc_id to tasks of about ``size`` bytes of text and have an order there, so the blocks are the same
    however the tables are split. A fifth of the doc_ids, by another hash, is marked as ``rest``.
    """
    known, text = known_labels(labels), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang"))
    n, length = rows.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(known, "doc_id").agg(F.count("*"), F.sum("bytes")).first()
    if not n:
        return None, 0
    tasks = -(-max(length, 1) // size)
    rest = F.pmod(F.xxhash64("doc_id", F.lit("rest")), F.lit(5)) == 0 if n >= APART else F.lit(False)
    # texts move once: few that have no label, and straight to the task that they belong to
    # a window in place of a join, which would deal them to as many tasks as the session's shuffles have
    both = marked(rows, known).withColumn("label", F.lit(None).cast("int")).unionByName(known.withColumnRenamed("toxic", "label"), allowMissingColumns=True)
    dealt = both.repartition(tasks, "doc_id").withColumn("toxic", F.max("label").over(Window.partitionBy("doc_id"))).where("label is null and toxic is not null")
    dealt = dealt.select("text", "lang", "toxic", rest.alias("rest"), F.xxhash64("doc_id", "text", "lang").alias("h")).sortWithinPartitions("h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in stretches(batch, 0, BLOCK):
                if len(words.buckets) > REMEMBERED:
                    words = Words()
                texts = words.texts(part.column(0))
                own, ids = np.unique(np.concatenate([np.zeros(1, np.int64), *texts]), return_inverse=True)  # number 0 stays padding
                flags = [np.asarray(part.column(c).to_numpy(zero_copy_only=False), np.uint8).tobytes() for c in (2, 3)]
                sizes = np.array([len(t) for t in texts], np.int64)
                row = [ids[1:].astype(np.int32).tobytes(), sizes.tobytes(), *flags, part.column(1).to_pylist(), words.buckets[own].astype(np.uint16).tobytes()]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row[:4]), pa.array([row[4]], pa.list_(pa.string())), pa.array([row[5]], pa.binary())], ["ids", "sizes", "toxic", "rest", "langs", "buckets"])

    return staged(dealt.mapInArrow(pack, BLOCKS)), n


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, list[str | None], np.ndarray]]:
    """(texts, toxic, rest, langs, buckets) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes, toxic, rest, langs, buckets = (batch.column(c)[k].as_py() for c in range(6))
            ends = np.cumsum(np.frombuffer(sizes, np.int64))[:-1]
            of = np.frombuffer(buckets, np.uint16).reshape(-1, 1 + len(PREFIXES)).astype(np.int32)
            yield np.split(np.frombuffer(ids, np.int32).astype(np.int64), ends), np.frombuffer(toxic, np.uint8), np.frombuffer(rest, np.uint8).astype(bool), langs, of


def counted(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Over all texts that train: the texts of each class by bucket, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, every = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for texts, toxic, rest, _, buckets in read_blocks(batches):
            seen += seen_in([t for t, r in zip(texts, rest, strict=True) if not r], toxic[~rest], buckets)
            every += np.bincount(toxic[~rest], minlength=2)
        labels, at = np.nonzero(seen)
        columns = [np.concatenate([at, [-1, -1]]), np.concatenate([labels, [0, 1]]), np.concatenate([seen[labels, at], every])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", "toxic", "n"])

    got = blocks.mapInArrow(count, "bucket long, toxic long, n long").groupBy("bucket", "toxic").agg(F.sum("n").alias("n")).toPandas()  # at most two rows a bucket
    seen, all_of = np.zeros((2, BUCKETS), np.int64), got.bucket < 0
    seen[got.toxic[~all_of], got.bucket[~all_of]] = got.n[~all_of]
    return seen, got[all_of].sort_values("toxic").n.to_numpy()


MOVED = "slice int, moved binary, change binary, squares binary"


def averaged(moves: DataFrame) -> list[np.ndarray]:
    """The mean of what tasks have moved, in the form of ``Training.flat``; of a bucket, over the tasks that have moved it.

    Each slice of the parameters is summed by one task, in whole numbers, so the order in which rows come makes no difference.
    """

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                place, moved = batch.column(0)[k].as_py(), np.frombuffer(batch.column(1)[k].as_py(), np.uint8).astype(np.int64)
                both = [np.rint(np.frombuffer(batch.column(c)[k].as_py(), np.float32).astype(float) * 2.0**32).astype(np.int64) for c in (2, 3)]
                total = [moved, *both] if total is None else [a + b for a, b in zip(total, (moved, *both), strict=True)]
        if total is not None:
            by = np.maximum(total[0], 1)[:, None] * 2.0**32
            out = [(t.reshape(len(by), -1) / by).astype(np.float32).tobytes() for t in total[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), *(pa.array([x], pa.binary()) for x in out)], ["slice", "change", "squares"])

    rows = sorted(moves.repartitionById(SLICES + 1, "slice").mapInArrow(mean, "slice int, change binary, squares binary").collect())  # one model in all
    change, squares = ([np.frombuffer(r[c], np.float32) for r in rows] for c in (1, 2))
    return [np.concatenate(change[:-1]).reshape(-1, DIM), np.concatenate(squares[:-1]).reshape(-1, DIM), change[-1][None, :], squares[-1][None, :]]


def trained(blocks: DataFrame, training: Training, seed: int, epochs: int = EPOCHS) -> Model:
    """Epochs over all texts that train: each task goes through its own from the model of the last epoch, and what they have moved is averaged."""
    context = blocks.sparkSession.sparkContext
    for epoch in range(epochs):
        shared = context.broadcast(training)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            own = copy.deepcopy(shared.value)
            before = [a.copy() for a in own.flat()]
            rng, any_of = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()]), False
            for texts, toxic, rest, _, buckets in read_blocks(batches):
                order = rng.permutation(np.flatnonzero(~rest))
                for at in range(0, len(order), BATCH):
                    batch, any_of = order[at : at + BATCH], True
                    own.step([texts[i] for i in batch], toxic[batch].astype(float), buckets, rate_of(epoch, epochs))
            if any_of:
                moved = [a - b for a, b in zip(own.flat(), before, strict=True)]
                each = BUCKETS // SLICES
                out = [(k, *(m[k * each : (k + 1) * each] for m in moved[:2])) for k in range(SLICES)] + [(SLICES, *moved[2:])]
                for place, change, squares in out:
                    which = (squares != 0).any(axis=1) | (change != 0).any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (which.astype(np.uint8), change, squares))], ["slice", "moved", "change", "squares"])

        training.add(averaged(blocks.mapInArrow(run, MOVED)))
        shared.destroy()
    return training.model


def cuts(logits: DataFrame) -> dict[str | None, float]:
    """From (lang, toxic, logit), the cut with the best F1 over all rows (None), and those of languages with 20 toxic rows or more: see ``best_threshold``.

    Equal logits are one; cumulative counts are those inside narrow cells of logits and the sums of the cells above.
    """
    of = ["every", "lang"]
    every = logits.select(F.lit(True).alias("every"), F.lit("").alias("lang"), "toxic", "logit")
    rows = every.unionByName(logits.where("lang is not null").select(F.lit(False).alias("every"), "lang", "toxic", "logit"))
    rows = rows.groupBy(*of, "logit").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    rows = staged(rows.withColumn("cell", F.floor(F.greatest(F.least("logit", F.lit(64.0)), F.lit(-64.0)) * 1024)))
    down = Window.partitionBy(*of).orderBy(F.desc("cell"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*of, "cell").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.max("logit").alias("high"))
    cells = cells.select(*of, "cell", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "t")), F.lead("high").over(down).alias("beyond"))
    inside = Window.partitionBy(*of, "cell").orderBy(F.desc("logit"))
    each = rows.select(*of, "cell", "logit", *(F.sum(c).over(inside).alias(f"{c}_in") for c in ("n", "t")), F.lead("logit").over(inside).alias("next"))
    each = each.join(cells, [*of, "cell"]).join(rows.groupBy(*of).agg(F.sum("n").alias("rows"), F.sum("t").alias("toxic")), of)
    f1 = 2 * (F.col("t_above") + F.col("t_in")) / (F.col("n_above") + F.col("n_in") + F.col("toxic"))
    each = each.where("toxic > 0 and toxic < rows and (every or toxic >= 20)").withColumn("low", F.coalesce("next", "beyond", F.col("logit") - 1))
    best = each.groupBy(*of).agg(F.max(F.struct(f1.alias("f1"), "logit", "low")).alias("best")).select(*of, "best.*")
    return {None if r.every else r.lang: (r.logit + r.low) / 2 for r in best.collect()}


def learned(docs: DataFrame, labels: DataFrame, seed: int = 1, size: int = PART) -> Model:
    """The model of every labelled row that may be learnt from: trained on four fifths of the doc_ids, calibrated on the rest.

    Under 200 rows all of them train and calibrate. The score is 0.5 at the cut that is best over all
    languages, as a language is no input of it; ``thresholds`` has the cuts, as scores, of languages with 20 toxic
    rows or more. The same rows give the same model. Only counts by bucket, parameters and cuts go to the driver.
    """
    with temporary(docs.sparkSession):
        blocks, n = labelled_blocks(docs, labels, size)
        if blocks is None:
            return begun(np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64), np.random.default_rng(seed))
        seen, count = counted(blocks)
        model = begun(seen, count, np.random.default_rng(seed))
        if not count.all():
            return model
        model = trained(blocks, Training(model), seed)
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for texts, toxic, rest, langs, buckets in read_blocks(batches):
                at = np.flatnonzero(rest) if n >= APART else np.arange(len(texts))
                if not len(at):
                    continue
                logits = shared.value.logits([texts[i] for i in at], shared.value.shares(buckets))
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in at], pa.string()), pa.array(toxic[at].astype(np.int32)), pa.array(logits.astype(float))], ["lang", "toxic", "logit"])

        best = cuts(blocks.mapInArrow(calibrate, "lang string, toxic int, logit double"))
        shared.destroy()
    model.shift = best.pop(None, model.shift)
    model.thresholds = {lang: float(model.score(np.array([best[lang]]))[0]) for lang in sorted(best)}
    return model


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, lang_threshold, flagged.

    Labels whose crc32(doc_id) is 0 modulo 5 are never read for training. Only the text makes the
    score; predicted is score >= 0.5, and flagged holds the score against the cut calibrated for the
    row's language, 0.5 where there is none. Null and empty texts have a score as well, from the
    bias; null doc_ids are held out; repeated rows give repeated rows and are learnt from as often, and of
    several labels of a doc_id the largest counts. Very long texts are pooled in parts. Without labels of both classes no text is predicted toxic. An
    empty table gives no rows; further columns are not read.
    """
    model = model or learned(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value, Words()
        shares = model.shares(words.matrix())

        def score(texts: list[np.ndarray]) -> np.ndarray:
            nonlocal shares
            known = len(shares[0][0])
            if known < len(words.buckets):
                new = model.shares(words.matrix(known))
                shares = [[np.concatenate([a, b]) for a, b in zip(x, y, strict=True)] for x, y in zip(shares, new, strict=True)]
            return model.score(model.logits(texts, shares))

        for batch in batches:
            out = [np.zeros(0)]
            for part in stretches(batch, 1, STRETCH):
                if len(words.buckets) > REMEMBERED:
                    words = Words()
                    shares = model.shares(words.matrix())
                out.append(score(words.texts(part.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64()), batch.column(2)], ["doc_id", "score", "lang"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    cuts = [F.lit(x) for kv in model.thresholds.items() for x in kv]
    cut = F.coalesce(F.create_map(*cuts)[F.col("lang")], F.lit(0.5)) if cuts else F.lit(0.5)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    out = rows.mapInArrow(run, "doc_id long, score double, lang string")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), cut.alias("lang_threshold"), (F.col("score") >= cut).alias("flagged"))
