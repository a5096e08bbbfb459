"""Katz back-off language model over words, counted, stored and evaluated in blocks.

The model has `order` orders.  With d the Good-Turing discounts of an order, c the training counts, h the order - 1 words
before and h' all of them but the first:

    P(w | h) = d(c(h w)) c(h w) / c(h)      if h w was seen in training
             = a(h) P(w | h')               otherwise, with a(h) = (1 - sum of the first line) / (1 - sum of P(. | h') over the same words)
    P(w)     = d(c(w)) c(w) / N             if w was seen in training
             = what the seen words leave    for all unknown words together

so all orders sum to exactly one over the known words and the unknown one.  A history not seen in training has a(h) = 1.  A
text is evaluated from its beginning (a word of its own, only ever in histories, which it fills up) to its end (a token like
others).

No token is a row.  Each task turns its documents into chunks: the distinct words' hashes, and each token as a number among
them.  A chunk sends each bucket of the vocabulary its distinct words there with their training counts; the bucket adds up
the counts of all chunks, numbers its words, stores both as its part of the model and answers each chunk in the order of its
question.  The same goes for longer n-grams, order by order, bucketed by their history, with their last words as numbers.
There the question also says how often the last word follows the shorter history: a word seen after h was seen after h' too,
so its P(w | h') is a discounted count over c(h'), and the bucket can add up what a(h) needs.  For a history with one seen
n-gram that the chunk asked about, the chunk has that sum itself.  What can't have been seen isn't asked: n-grams whose
history or shorter n-gram was not.  Before it asks for an order, a chunk evaluates the one below from the answers that it
has.  A frequent history is split over several buckets by the last word; its sums are added up in a home bucket,
which the chunks ask too, so nothing of it comes to the driver.  A chunk sends a bucket one message at most, and none
without an n-gram in it, so messages never outnumber n-grams.

A stored table has the form of a question, so `score` evaluates a model on other texts by the same steps, with the tables in
place of counts.  Words are told apart by 64-bit hashes until they have numbers, histories of one or two words by those
numbers, longer ones by 64-bit hashes.

Chunks ask and score in groups, so that only a group of them is shuffled at once; the questions wait in a table by parts of
the buckets, and a part's go when it has been counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P
from .common import buckets_for, crc_mod, materialise, remove, scratch, writing

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens that make a chunk full.
CHUNK_TOKENS = 3 << 19
#: Chunks ask and are scored in so many groups, one after the other.
GROUPS = 8
#: The buckets of an order are counted in so many parts, one after the other.
PARTS = 4
#: Of longer ones, in so many.
LONG_PARTS = 8
#: Groups of buckets, a folder each, of a saved model.
FOLDERS = 64
#: From triples on there are so many times the buckets, as more of the n-grams are distinct.
LONG_BUCKETS = 3
END = P.U64(0x5EED0E4D5EED0E4D)
#: Numbers of words not seen in training, of the beginning, and of the first of all others.
UNSEEN, BEGIN, FIRST = P.U64(0), P.U64(1), 2
MESSAGE = "kind int, chunk long, bucket int, data binary"
#: Kinds of messages.
CHUNK, ASK_WORDS, TELL_WORDS, ASK_GRAMS, TABLE, STATS, HOT, ASK_HOT = range(8)
TELL_GRAMS, TELL_HOT = 100, 200  # and n for order n
#: How a chunk learns the sums of a history: from the answer, from its one seen n-gram, or from the home bucket.
TOLD, ALONE, SPLIT = range(3)


def message(kind: int, chunks, buckets, blocks: list[bytes]) -> pa.RecordBatch:
    n = len(blocks)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.broadcast_to(np.asarray(chunks, np.int64), n)), pa.array(np.broadcast_to(np.asarray(buckets, np.int32), n)), pa.array(blocks, pa.binary())],
        ["kind", "chunk", "bucket", "data"],
    )


def discounts(n: np.ndarray, k: int = DISCOUNTED) -> np.ndarray:
    """d[r] for counts r up to k (d[0] is unused), from n[r], the number of n-grams seen r times, up to k + 1.

    Good-Turing with Katz's correction; where the counts of counts don't give a number between 0 and 1 (as a corpus full of
    copies may not), absolute discounting stands in for that r.
    """
    d = np.ones(k + 1)
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 else 0.5
    a = (k + 1) * n[k + 1] / n[1] if n[1] > 0 else 1.0
    for r in range(1, k + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] > 0 and a < 1 else 0.0
        d[r] = good if 0 < good < 1 else 1 - min(absolute, 0.95) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)


class Unigrams:
    """P(w) by a word's training count."""

    def __init__(self, total: int, distinct: int, n: np.ndarray):
        self.total, self.distinct, self.d = int(total), int(distinct), discounts(n)
        left = float(sum(r * n[r] * (1 - self.d[r]) for r in range(1, len(self.d)))) / total if total else 1.0
        # nothing left (no rare words at all): one more token, the unknown one
        self.scale = 1.0 if left > 0 else total / (total + 1)
        self.unknown = left if left > 0 else 1 / (total + 1)

    def probability(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return np.where(c > 0, self.scale * discounted(c, self.d) / max(self.total, 1), self.unknown)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, with an END after each text, and the texts' token counts."""
    words = P.Words(column)
    count = words.count + 1
    out = np.empty(count.sum(), P.U64)
    out[np.arange(len(words.hash)) + words.text] = words.hash
    out[np.cumsum(count) - 1] = END
    return out, count


def by_bucket(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, first, end) of the groups of equal numbers."""
    small = len(to) and to.max() < 1 << 16  # numpy sorts those by radix
    order = np.argsort(to.astype(np.uint16) if small else to, kind="stable")
    to = to[order]
    first = np.flatnonzero(np.r_[len(to) > 0, to[1:] != to[:-1]])
    return order, to[first], first, np.r_[first[1:], len(to)].astype(np.int64)


def cut():
    """For mapInArrow: chunks."""

    def close(chunk, tokens, counts, ids, held):
        h, count = np.concatenate(tokens), np.concatenate(counts)
        held = np.concatenate(held)
        words, local, often = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.argsort(-often, kind="stable")  # small numbers for frequent words
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        words, local = words[rank], place[local]
        yield message(CHUNK, chunk, 0, [P.pack(words, local.astype(np.uint32), count.astype(np.uint32), np.concatenate(ids), held.astype(np.uint8))])

    def read(batches):
        from pyspark import TaskContext

        chunk, held_back, size = TaskContext.get().partitionId() << 32, ([], [], [], []), 0
        for part in P.slices(batches):
            tokens, count = tokens_of(part.column("text"))
            ids = part.column("id")
            for to, x in zip(held_back, (tokens, count, np.stack([np.asarray(ids.fill_null(0)), np.asarray(ids.is_null().cast(pa.int64()))], 1).ravel(), np.asarray(part.column("held").cast(pa.int8())).astype(bool))):
                to.append(x)
            size += len(tokens)
            if size >= CHUNK_TOKENS:
                yield from close(chunk, *held_back)
                chunk, held_back, size = chunk + 1, ([], [], [], []), 0
        if size:
            yield from close(chunk, *held_back)

    return read


def gather(batches) -> list[tuple[int, int, int, bytes]]:
    out = []
    for part in batches:
        out += zip(*(part.column(c).to_pylist() for c in ("kind", "chunk", "bucket", "data")))
    return sorted(out, key=lambda x: x[:3])


def ask_words(buckets: int):
    """For mapInArrow: what each chunk asks the buckets of the vocabulary."""

    def ask(batches):
        for _, chunk, _, data in (x for part in batches for x in gather([part])):
            words, local, count, _, held = P.unpack(data)
            train = np.bincount(local[np.repeat(held == 0, count)], minlength=len(words))
            order, bucket, first, end = by_bucket((words % P.U64(buckets)).astype(np.int32))
            yield message(ASK_WORDS, chunk, bucket, [P.pack(words[order[a:b]], train[order[a:b]].astype(np.uint32)) for a, b in zip(first, end)])

    return ask


def count_words(buckets: int):
    """One bucket of the vocabulary: its table, its counts of counts, and the answers to all chunks.

    A stored table counts too, and its words keep their numbers; else frequent words get small ones, which pack well.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = gather(batches)
        parts = [P.unpack(x[3]) for x in asked]
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(words)).astype(np.int64)
        seen = total > 0
        bucket = asked[0][2]
        number = np.empty(len(words), P.U64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(words), dtype=P.U64) * P.U64(buckets) + P.U64(bucket + FIRST)
        for x, p in zip(asked, parts):
            if x[0] == TABLE:
                number[np.searchsorted(words, p[0])] = p[2]
        yield message(TABLE, -1, bucket, [P.pack(words[seen], total[seen], number[seen])])
        yield message(STATS, -1, bucket, [P.pack(np.r_[total.sum(), seen.sum(), np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]])])
        end = np.cumsum([len(p[0]) for p in parts])
        for x, p, e in zip(asked, parts, end):
            if x[0] == ASK_WORDS:
                mine = at[e - len(p[0]) : e]
                yield message(TELL_WORDS, x[1], bucket, [P.pack(total[mine], np.where(seen[mine], number[mine], UNSEEN))])

    return count


def distinct(code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, a place of each, each place's number among them), for codes below `most`."""
    n = len(code)
    bits = max(n - 1, 1).bit_length()
    if most.bit_length() + bits <= 64:  # code and place in one number: a plain sort is much faster than one of places
        x = np.sort((code.astype(P.U64) << P.U64(bits)) | np.arange(n, dtype=P.U64))
        order, code = (x & P.U64((1 << bits) - 1)).astype(np.int64), (x >> P.U64(bits)).astype(np.int64)
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
    new = np.ones(n, bool)
    np.not_equal(code[1:], code[:-1], out=new[1:])
    at = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    at[order] = np.cumsum(new) - 1
    return code[new], order[new], at


class Order:
    """What the counted buckets of one order have in common."""

    def __init__(self, n: int, buckets: int, total: int):
        self.n, self.buckets = n, buckets * (LONG_BUCKETS if n > 2 else 1)
        self.hot_count = max(1024, total // (4 * self.buckets))
        self.d = np.ones(DISCOUNTED + 1)


def joined(history: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """Keys of histories of `size` words, from those without the last one and its number."""
    long = P.mix(P.mix(history + P.U64(5)) + word)
    if size > 2:
        return long
    pair = (history < P.U64(1 << 32)) & (word < P.U64(1 << 31))  # two numbers in one; huge ones don't fit
    return np.where(pair, (history << P.U64(31)) | word, long | P.U64(1 << 63))


class Words:
    """The distinct words of a chunk: number, training count and probability of each, and each token's place among them."""

    def __init__(self, chunk: Chunk, told: dict[int, bytes], buckets: int, unigrams: Unigrams):
        order, bucket, first, end = by_bucket((chunk.words % P.U64(buckets)).astype(np.int32))
        self.at, self.begin, self.d = chunk.local, np.array([BEGIN]), unigrams.d
        self.count, self.key = np.zeros(len(chunk.words), np.int64), np.zeros(len(chunk.words), P.U64)
        for b, i, j in zip(bucket, first, end):
            self.count[order[i:j]], self.key[order[i:j]] = P.unpack(told[int(b)])
        self.p = unigrams.probability(self.count)
        self.rate = np.full(len(self.key) + 1, unigrams.scale / max(unigrams.total, 1))


class Grams:
    """The distinct n-grams of a chunk, by bucket if their history was seen; `take` gives their training counts and probabilities.

    `rate` is, for each n-gram and for the beginning as the history of the next order, what a discounted count after that
    history without its first word is multiplied by to be a probability.
    """

    def __init__(self, chunk: Chunk, below: Words | Grams, order: Order, begins: int):
        self.of, size, self.below_rate = order, len(chunk.words), below.rate
        self.d, self.below_d = order.d, below.d
        self.keys, self.often = np.r_[below.key, below.begin], np.r_[below.count, begins]
        self.begin = joined(below.begin, np.array([BEGIN]), order.n)
        history = np.empty(len(chunk.local), np.int64)
        history[1:] = below.at[:-1]
        history[chunk.starts] = len(below.key)  # the beginning is the history of each text's first token
        history *= size
        history += chunk.local
        code, one, self.at = distinct(history, len(self.keys) * size)
        del history
        self.train = np.bincount(self.at[chunk.train], minlength=len(code)).astype(np.uint32)
        self.history, self.word = (code // size).astype(np.int32), (code % size).astype(np.int32)
        del code
        self.suffix = below.at[one].astype(np.int32)  # the n-gram without its first word
        del one
        self.below_p, self.asked = below.p, below.count[self.suffix].astype(np.uint32)
        self.numbers = chunk.unigrams.key
        bucket = order_bucket(self.keys, P.U64(0), order.buckets)[self.history]
        hot = np.flatnonzero((self.often > order.hot_count)[self.history])
        splits = (-(-self.often[self.history[hot]] // order.hot_count)).astype(P.U64)
        spread = P.mix(self.numbers[self.word[hot]] + P.U64(3)) % splits + P.U64(1)
        bucket[hot] = order_bucket(self.keys[self.history[hot]], spread, order.buckets)
        known = np.flatnonzero((self.often > 0)[self.history]).astype(np.int32)
        at, self.bucket, self.first, self.end = by_bucket(bucket[known])
        self.order = known[at]

    def runs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one bucket, the histories, the n-grams asked about (their last words follow the shorter histories), and how many of each history."""
        grams = self.order[a:b]
        h = self.history[grams]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        asked = self.asked[grams] > 0
        return h[first], grams[asked], np.add.reduceat(asked.astype(np.int64), first)

    def split(self) -> Iterator[tuple[int, np.ndarray]]:
        """(home bucket, histories) of the chunk's histories that are split over several buckets.

        Not all keys are histories here; those that end a text are none anywhere, and no bucket would answer.
        """
        used = np.zeros(len(self.keys), bool)
        used[self.history] = True
        hot = np.flatnonzero(used & (self.often > self.of.hot_count))
        order, bucket, first, end = by_bucket(order_bucket(self.keys[hot], P.U64(0), self.of.buckets))
        for b, i, j in zip(bucket, first, end):
            yield int(b), hot[order[i:j]]

    def take(self, told: dict[int, bytes], told_hot: dict[int, bytes], unigrams: Unigrams) -> None:
        self.count = np.zeros(len(self.history), np.int64)
        d, often = self.d, self.often
        lost = np.arange(1, DISCOUNTED + 1) * (1 - d[1:])
        left, mass = np.zeros(len(self.keys)), np.zeros(len(self.keys))
        for bucket, a, b in zip(self.bucket, self.first, self.end):
            total, how, rare, m = P.unpack(told[int(bucket)])
            h, grams, number = self.runs(a, b)
            self.count[grams] = total
            answered = h[how == TOLD]
            left[answered], mass[answered] = (rare.reshape(-1, DISCOUNTED) * lost).sum(1), m
            alone = (total > 0) & np.repeat(how == ALONE, number)
            own, c = h[how == ALONE], total[alone].astype(np.int64)
            left[own] = np.where(c <= DISCOUNTED, lost[np.minimum(c, DISCOUNTED) - 1], 0.0)
            mass[own] = discounted(self.asked[grams[alone]].astype(np.int64), self.below_d)
        for bucket, h in self.split():
            rare, m = P.unpack(told_hot[bucket])
            left[h], mass[h] = (rare.reshape(-1, DISCOUNTED) * lost).sum(1), m
        left, mass = left / np.maximum(often, 1), mass * self.below_rate
        none = (left <= 0) & (often > 0)  # a history without rare n-grams: one more token, one not seen after it
        scale = np.where(none, often / (often + 1), 1.0)
        left = np.where(none, 1 / (often + 1), left)
        back = np.where(often > 0, left / np.maximum(1 - mass, unigrams.unknown if self.of.n == 2 else 1e-12), 1.0)
        per = scale / np.maximum(often, 1)
        h = self.history
        del self.asked, self.train, self.order, left, mass
        self.p = np.where(self.count > 0, per[h] * discounted(self.count, d), back[h] * self.below_p[self.suffix])
        del self.below_p
        self.rate = per[np.r_[self.suffix, np.int32(len(self.keys) - 1)]]
        self.key = joined(self.keys[h], self.numbers[self.word], self.of.n)
        del self.suffix, self.history, self.word, self.keys, self.often


def order_bucket(history: np.ndarray, sub, buckets: int) -> np.ndarray:
    return (P.mix(history + sub * P.BASE) % P.U64(buckets)).astype(np.int32)


class Chunk:
    """A chunk with its words, and its n-grams up to the last of `orders`; those of the last are only taken if it is counted."""

    def __init__(self, messages: list[tuple[int, int, int, bytes]], buckets: int, unigrams: Unigrams, orders: list[Order], begins: int, counted: int):
        (own,) = (x for x in messages if x[0] == CHUNK)
        self.id = own[1]
        self.words, local, self.count, ids, held = P.unpack(own[3])
        self.local = local.view(np.int32)
        self.ids, self.held = ids.reshape(-1, 2), held.astype(bool)
        self.starts = np.cumsum(self.count.astype(np.int64)) - self.count
        self.train = np.repeat(~self.held, self.count)

        def told(kind: int) -> dict[int, bytes]:
            return {x[2]: x[3] for x in messages if x[0] == kind}

        del own

        self.unigrams = self.top = Words(self, told(TELL_WORDS), buckets, unigrams)
        for order in orders:
            self.top = Grams(self, self.top, order, begins)
            if order.n <= counted:
                self.top.take(told(TELL_GRAMS + order.n), told(TELL_HOT + order.n), unigrams)


def ask_grams(buckets: int, unigrams: Unigrams, orders: list[Order], begins: int):
    """What a chunk asks the buckets of the last order.

    It asks the home buckets of split histories too, for sums over all of their buckets.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(gather(batches), buckets, unigrams, orders, begins, orders[-1].n - 1)
        top, hot = chunk.top, orders[-1].hot_count
        for bucket, a, b in zip(top.bucket, top.first, top.end):
            h, grams, number = top.runs(a, b)
            split = (top.often[h] > hot).astype(np.uint8)
            block = P.pack(top.keys[h], number.astype(np.uint32), split, top.numbers[top.word[grams]], top.asked[grams], top.train[grams])
            yield message(ASK_GRAMS, chunk.id, bucket, [block])
        for bucket, h in top.split():
            yield message(ASK_HOT, chunk.id, bucket, [P.pack(top.keys[h])])
        del chunk, top
        P.trim()

    return ask


def in_order(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (h, w), h being small numbers, and where a new pair begins in it."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, bool)
    bits, more = int(h.max()).bit_length(), int(w.max()).bit_length()
    cut = max(0, bits + more - 64)
    key = (h.astype(P.U64) << P.U64(more - cut)) | (w >> P.U64(cut))
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    if cut and (w[order[1:]] != w[order[:-1]])[~new[1:]].any():  # words that only the bits cut off tell apart
        order = np.lexsort((w, h))
        new = np.r_[True, (h[order[1:]] != h[order[:-1]]) | (w[order[1:]] != w[order[:-1]])]
    return order, new


def count_grams(n: int, d: np.ndarray, buckets: int):
    """One bucket of n-grams: its table, its counts of counts, the sums of split histories, and the answers to all chunks.

    Stored tables are taken as questions that nobody waits for.  d: the discounts of the order below.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = gather(batches)
        for x in asked:
            if x[0] == ASK_HOT:  # the home bucket's, on its way
                yield message(ASK_HOT, x[1], x[2], [x[3]])
        asked = [x for x in asked if x[0] != ASK_HOT]
        if not asked:
            return
        parts = [P.unpack(x[3]) for x in asked]
        bucket = asked[0][2]
        number = np.concatenate([p[1] for p in parts])
        keys, own = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        split = np.zeros(len(keys), bool)
        split[own] = np.concatenate([p[2] for p in parts]) > 0
        h = np.repeat(own.astype(np.uint32), number)
        w, lower, c = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        order, new = in_order(h, w)
        group = np.cumsum(new) - 1
        total = np.add.reduceat(c[order].astype(np.int64), np.flatnonzero(new))
        at = np.empty(len(order), np.int32)
        at[order] = group
        one = order[new]
        del order, group, new
        h, w, lower = h[one], w[one], lower[one]
        seen = total > 0
        # the table: a question of all that was seen, each history once
        number = np.bincount(h[seen], minlength=len(keys))
        some = number > 0
        yield message(TABLE, -1, bucket, [P.pack(keys[some], number[some].astype(np.uint32), split[some].astype(np.uint8), w[seen], lower[seen], total[seen].astype(np.uint32))])
        yield message(STATS, -1, bucket, [P.pack(np.r_[total.sum(), seen.sum(), np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]])])
        # by history: numbers of n-grams seen 1 .. DISCOUNTED times, and the discounted lower counts of all words seen after it
        rare = np.stack([np.bincount(h[total == r], minlength=len(keys)) for r in range(1, DISCOUNTED + 1)], 1)
        mass = np.bincount(h, weights=np.where(seen, discounted(lower.astype(np.int64), d), 0.0), minlength=len(keys))
        hot = np.flatnonzero(split)
        alone = total == np.bincount(h, weights=total, minlength=len(keys))[h]  # all that was seen after its history
        alone &= seen
        home = order_bucket(keys[hot], P.U64(0), buckets)
        for b in np.unique(home):
            k = hot[home == b]
            yield message(HOT, -1, b, [P.pack(keys[k], rare[k].ravel(), mass[k])])
        end, last = np.cumsum([len(p[3]) for p in parts]), np.cumsum([len(p[0]) for p in parts])
        for x, p, e, f in zip(asked, parts, end, last):
            if x[0] == ASK_GRAMS:
                mine, k = at[e - len(p[3]) : e], own[f - len(p[0]) : f]
                how = np.where(split[k], SPLIT, TOLD).astype(np.uint8)
                one = np.repeat(np.arange(len(k)), p[1])[alone[mine]]
                how[one[how[one] == TOLD]] = ALONE
                k = k[how == TOLD]
                yield message(TELL_GRAMS + n, x[1], bucket, [P.pack(total[mine].astype(np.uint32), how, rare[k].ravel().astype(np.uint32), mass[k])])

    return count


def sum_hot(n: int):
    """One home bucket of split histories: its answers to all chunks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = gather(batches)
        parts = [P.unpack(x[3]) for x in sent if x[0] == HOT]
        if not parts:
            return
        keys, own = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        rare, mass = np.zeros((len(keys), DISCOUNTED), np.int64), np.bincount(own, weights=np.concatenate([p[2] for p in parts]))
        np.add.at(rare, own, np.concatenate([p[1] for p in parts]).reshape(-1, DISCOUNTED).astype(np.int64))
        for x in sent:
            if x[0] == ASK_HOT:
                k = np.searchsorted(keys, P.unpack(x[3])[0])
                yield message(TELL_HOT + n, x[1], x[2], [P.pack(rare[k].ravel(), mass[k])])

    return add


def evaluate(buckets: int, unigrams: Unigrams, orders: list[Order], begins: int, id_col: str):
    """The scores of a chunk's texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(gather(batches), buckets, unigrams, orders, begins, len(orders) + 1)
        first, c = chunk.starts, chunk.unigrams.count
        base = np.log10((c + 1) / (unigrams.total + unigrams.distinct + 1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(chunk.ids[:, 0], mask=chunk.ids[:, 1] > 0),
                pa.array(chunk.held),
                pa.array(chunk.count.astype(np.int64)),
                pa.array(np.add.reduceat((c > 0)[chunk.local].astype(np.int64), first)),
                pa.array(np.full(len(first), unigrams.total)),
                pa.array(np.add.reduceat(base[chunk.local], first)),
                pa.array(np.add.reduceat(np.log10(chunk.top.p)[chunk.top.at], first)),
            ],
            [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )
        del chunk
        P.trim()

    return score


def statistics(table: DataFrame) -> np.ndarray:
    """The sums of the buckets' statistics; a few numbers from each bucket come to the driver."""
    return sum((P.unpack(r.data)[0] for r in table.where(F.col("kind") == STATS).select("data").toLocalIterator()), np.zeros(DISCOUNTED + 4, np.int64))


class KatzModel:
    """A trained model: numbers that all orders share, and its tables of words and n-grams, by order and bucket."""

    def __init__(self, buckets: int, begins: int):
        self.buckets, self.begins = buckets, begins
        self.unigrams: Unigrams | None = None
        self.orders: list[Order] = []
        self.tables: list[DataFrame] = []

    def save(self, path: str) -> None:
        """Writes the tables below the path, partitioned by order and by `FOLDERS` groups of buckets, and the numbers beside them."""
        spark = self.tables[0].sparkSession
        named = (t.select(F.lit(k + 1).alias("order"), F.pmod("bucket", F.lit(FOLDERS)).alias("folder"), "bucket", "data") for k, t in enumerate(self.tables))
        whole = reduce(DataFrame.unionByName, named)
        whole.write.mode("overwrite").partitionBy("order", "folder").option("compression", "none").parquet(f"{path}/tables")
        facts = {"buckets": self.buckets, "begins": self.begins, "unigrams": vars(self.unigrams) | {"d": self.unigrams.d.tolist()}, "orders": [vars(o) | {"d": o.d.tolist()} for o in self.orders]}
        spark.createDataFrame([(json.dumps(facts, default=float),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark, path: str) -> KatzModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        model = cls(facts["buckets"], facts["begins"])
        model.unigrams = Unigrams.__new__(Unigrams)
        vars(model.unigrams).update(facts["unigrams"] | {"d": np.array(facts["unigrams"]["d"])})
        for o in facts["orders"]:
            order = Order.__new__(Order)
            vars(order).update(o | {"d": np.array(o["d"])})
            model.orders.append(order)
        stored = spark.read.parquet(f"{path}/tables")
        columns = F.lit(TABLE).alias("kind"), F.lit(-1).cast("long").alias("chunk"), "bucket", "data"
        model.tables = [stored.where(F.col("order") == k).select(*columns) for k in range(1, len(model.orders) + 2)]
        return model


def cut_up(docs: DataFrame, id_col: str, text_col: str, held) -> tuple[DataFrame, DataFrame]:
    """The rows that matter, and the chunks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    return rows, materialise(rows.mapInArrow(cut(), MESSAGE), "katz-chunks", "none")


def answer(model: KatzModel, chunks: DataFrame, order: int, stored: bool) -> DataFrame:
    """The chunks with the answers to all their questions, from the model's tables or, if nothing is stored, from their own counts.

    What is counted becomes the model's.  Chunks ask for an order when they know all about the one below.
    """
    spark, b = chunks.sparkSession, model.buckets

    def of(kind: int, table: DataFrame) -> DataFrame:
        return table.where(F.col("kind") == kind)

    asked = chunks.mapInArrow(ask_words(b), MESSAGE)
    asked = asked.unionByName(model.tables[0]) if stored else asked
    words = materialise(asked.groupBy("bucket").applyInArrow(count_words(b), MESSAGE), "katz-words", "none")
    if not stored:
        total, different, *n = statistics(words)
        model.unigrams = Unigrams(total, different, np.array(n))
        model.tables.append(of(TABLE, words))
    known = chunks.unionByName(of(TELL_WORDS, words))
    for n in range(2, order + 1):
        if not stored:
            model.orders.append(Order(n, b, model.unigrams.total))
        orders, grams = model.orders[: n - 1], []
        below = model.unigrams.d if n == 2 else orders[-2].d
        parts = PARTS if n == 2 else LONG_PARTS
        part_of = F.pmod("bucket", F.lit(parts))
        questions = scratch(spark, "katz-questions")
        for group in groups(known):
            asked = group.groupBy("chunk").applyInArrow(ask_grams(b, model.unigrams, orders, model.begins), MESSAGE)
            with writing(spark):
                asked.withColumn("part", part_of).write.mode("append").partitionBy("part").option("compression", "none").parquet(questions)
        for part in range(parts):
            asked = spark.read.schema(f"{MESSAGE}, part int").parquet(questions).where(F.col("part") == part).drop("part")
            if stored:
                asked = asked.unionByName(model.tables[n - 1].where(part_of == part))
            counted = asked.groupBy("bucket").applyInArrow(count_grams(n, below, orders[-1].buckets), MESSAGE)
            grams.append(materialise(counted, "katz-grams", "none"))
            remove(spark, f"{questions}/part={part}")
        counted = reduce(DataFrame.unionByName, grams)
        if not stored:
            orders[-1].d = model.orders[n - 2].d = discounts(statistics(counted)[2:])
            model.tables.append(of(TABLE, counted))
        hot = counted.where(F.col("kind").isin(HOT, ASK_HOT)).groupBy("bucket").applyInArrow(sum_hot(n), MESSAGE)
        known = known.unionByName(of(TELL_GRAMS + n, counted)).unionByName(materialise(hot, "katz-hot", "none"))
    return known


def groups(known: DataFrame) -> list[DataFrame]:
    """The chunks with their answers, in groups of about equal numbers of chunks."""
    number = F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1))
    return [known.where(F.pmod(number, F.lit(GROUPS)) == g) for g in range(GROUPS)]


def scored(model: KatzModel, known: DataFrame, id_col: str) -> DataFrame:
    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    score_chunk = evaluate(model.buckets, model.unigrams, model.orders, model.begins, id_col)
    done = [materialise(g.groupBy("chunk").applyInArrow(score_chunk, schema), "katz-scores") for g in groups(known)]
    return reduce(DataFrame.unionByName, done)


def train_and_answer(docs: DataFrame, id_col: str, text_col: str, held, order: int) -> tuple[KatzModel, DataFrame]:
    rows, chunks = cut_up(docs, id_col, text_col, held)
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~F.col("held"), 1)).alias("begins")).first()
    model = KatzModel(buckets_for(docs.sparkSession, size.bytes or 0), size.begins)
    return model, answer(model, chunks, order, stored=False)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> KatzModel:
    """The model of all texts, for `score` and `KatzModel.save`."""
    return train_and_answer(docs, id_col, text_col, F.lit(False), order)[0]


def score(model: KatzModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `score_corpus`, under a model trained elsewhere, from its tables; held_out is true for all rows."""
    _, chunks = cut_up(docs, id_col, text_col, F.lit(True))
    return scored(model, answer(model, chunks, len(model.orders) + 1, stored=True), id_col)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, folds: int = 7, order: int = 3) -> DataFrame:
    """Scores of all texts under the model, of n-grams up to `order` words, of those outside the held-out fold (crc32 of the id as text, modulo folds).

    Returns the id, held_out, n_tokens, n_known, train_tokens, base_score (an add-one unigram model) and score, all log10.
    A null or empty text is one token, its end.  A null id counts as an empty text for the fold.  If all texts are held out,
    every probability is 1 and every score 0.  Repeated rows count as often as they occur.  A text of any length is scored
    whole.  An empty table gives an empty result.  Other columns aren't read, whatever their names.
    """
    held = crc_mod(F.col(id_col), folds) == held_out
    model, known = train_and_answer(docs, id_col, text_col, held, order)
    return scored(model, known, id_col)
