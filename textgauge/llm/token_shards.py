"""Token IDs in training order: fixed-stride binary shards.

Documents become token IDs, with an end token after each, and all of them, one after the other, one stream of tokens that is
cut into sequences of a fixed length; only the last sequence is filled up.  A keyed Feistel permutation of the sequences'
numbers, which walks along its cycle while it is outside the range, gives each sequence a slot of its own in the training
order, with no table and no sort.  A shard is a range of slots; slot s lies in shard s // per_shard, at byte
(s % per_shard) * stride, so that a reader can begin anywhere.

The texts are encoded once, into a table whose rows know their place in their task's stream.  The tasks' totals place all
tasks in the whole stream; then the table is dealt by ranges of slots, a few rounds after the other, so that only one round's
rows are in a shuffle at once.

Words recur, so a task encodes each distinct piece of a slice (a word with the blank before it, or white space) once.  No
merge of these vocabularies crosses such pieces.
"""

from __future__ import annotations

import base64
import posixpath
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P
from .common import drop_table, materialise, scratch

#: A tiktoken rank file and the pattern that goes with it: production parameters, not part of the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The first free id stands for the end of a document, and fills the last sequence.
END = 50_256
LENGTH = 1024
#: Sequences a shard, 8 MB.
PER_SHARD = 4096
KEY = 0x1D872B41
#: The shards are dealt and written in so many rounds, each of so many partitions at most.
ROUNDS = 3
PARTITIONS_MOST = 10_000
#: White space outside ASCII, as UTF-8: texts with it are encoded as a whole.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[[ord(c) for c in ",.;:!?"]] = True


def permute(x: np.ndarray, n: int, key: int = KEY, rounds: int = 6, back: bool = False) -> np.ndarray:
    """The slots of the numbers x < n: a keyed permutation of 0 .. n - 1; `back` gives the numbers of slots."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = P.U64((1 << half) - 1), P.U64(half)
    keys = P.mix(P.U64(key) + np.arange(1, rounds + 1, dtype=P.U64) * P.BASE)
    out = x.astype(P.U64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> shift, out[walk] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (P.mix(left + k) & mask), left
            else:
                left, right = right, left ^ (P.mix(right + k) & mask)
        out[walk] = (left << shift) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the pieces, in order."""
    starts, ends, text = P.word_spans(raw, offsets)
    first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.empty(0, bool)
    gap = np.where(first, offsets[text], np.r_[0, ends[:-1]] if len(ends) else starts)
    wide = starts > gap
    glued = wide & (raw[np.maximum(starts - 1, 0)] == 0x20)
    loose, body = wide & ~glued, starts - gap > 1
    last = offsets[:-1].copy()  # where the white space at the end of each text begins
    last[text] = ends
    tail = last < offsets[1:]
    # marks at a word's end after a letter are a piece: "word," and "word" share theirs
    stem, lengths = ends.copy(), ends - starts
    for k in range(3):
        can = (lengths > k + 1) & (stem == ends - k)
        stem -= can & MARK[raw[np.maximum(stem - 1, 0)]]
    cut = (stem < ends) & LETTER[raw[np.maximum(stem - 1, 0)]]
    stem = np.where(cut, stem, ends)
    s = np.concatenate([starts - glued, stem[cut], gap[body], starts[loose] - 1, last[tail]])
    e = np.concatenate([stem, ends[cut], starts[body] - 1, starts[loose], offsets[1:][tail]])
    t = np.concatenate([text, text[cut], text[body], text[loose], np.flatnonzero(tail)])
    order = np.argsort(s, kind="stable")
    return s[order], e[order], t[order]


class Encoder:
    """Encodes slices of one task; pieces that have come before are not encoded again."""

    MOST = 1 << 20

    def __init__(self, vocabulary: bytes, pattern: str, end: int = END):
        self.bpe, self.end = encoder(vocabulary, pattern), end
        self.clear()

    def clear(self):
        #: By piece, ordered by hash: its hash, where its bytes begin in `text`, and its ids in `flat`.
        self.hash, self.bytes, self.size, self.begin = np.empty(0, P.U64), *(np.empty(0, np.int64) for _ in range(3))
        self.flat, self.text = np.empty(0, np.int32), np.empty(0, np.uint8)

    def learn(self, data: bytes, h: np.ndarray, s: np.ndarray, e: np.ndarray):
        new = [data[a:b] for a, b in zip(s.tolist(), e.tolist())]
        ids = [self.bpe.encode_ordinary(x.decode("utf-8", "replace")) for x in new]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        h = np.concatenate([self.hash, h])
        order = np.argsort(h)
        begin, at = len(self.flat) + np.cumsum(n) - n, len(self.text) + np.cumsum(e - s) - (e - s)
        both = ((self.size, n), (self.begin, begin), (self.bytes, at))
        self.hash, (self.size, self.begin, self.bytes) = h[order], (np.concatenate(x)[order] for x in both)
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(new), np.uint8)])

    def whole(self, text: bytes) -> np.ndarray:
        return np.array([*self.bpe.encode_ordinary(text.decode("utf-8", "replace")), self.end], np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, each with the end token after it; their numbers by text)."""
        raw, offsets = P.text_buffer(column)
        data = raw.tobytes()
        s, e, t = pieces(raw, offsets)
        h = P.span_hashes(raw, s, e)
        key, at, which = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(~P.member_of(key, self.hash))
        if len(new):
            if len(self.hash) > self.MOST:
                self.clear()
                new = np.arange(len(key))
            self.learn(data, key[new], s[at[new]], e[at[new]])
        which = np.searchsorted(self.hash, key)[which]
        size, begin = self.size[which], self.begin[which]
        count = np.bincount(t, weights=size, minlength=len(offsets) - 1).astype(np.int64) + 1
        out = np.full(count.sum(), self.end, np.int32)
        within = np.cumsum(size) - size
        at = np.arange(size.sum())
        out[at + np.repeat(t, size)] = self.flat[at + np.repeat(begin - within, size)]  # t end tokens stand before
        # texts with white space outside ASCII, and those with a piece that only has the hash of the one that stands for it
        odd = np.searchsorted(offsets, [m.start() for m in WIDE_SPACE.finditer(data)], side="right") - 1
        same = self.text[np.minimum(np.arange(len(raw)) + np.repeat(self.bytes[which] - s, e - s), max(len(self.text) - 1, 0))] == raw
        if not same.all():
            odd = np.concatenate([odd, np.searchsorted(offsets, np.flatnonzero(~same), side="right") - 1])
        if len(odd):
            parts = np.split(out, np.cumsum(count)[:-1])
            for k in np.unique(odd).astype(int):
                parts[k] = self.whole(data[offsets[k] : offsets[k + 1]])
            count = np.array([len(x) for x in parts], np.int64)
            out = np.concatenate(parts)
        return out, count


def encoded(rows: DataFrame, vocabulary: bytes, pattern: str, end: int, kind: str) -> DataFrame:
    """A row for each slice of the texts: its task, the tokens of the task before it and its own, and the packed tokens."""
    told = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches):
        from pyspark import TaskContext

        task, before, bpe = TaskContext.get().partitionId(), 0, Encoder(told.value, pattern, end)
        for part in P.slices(batches):
            tokens, count = bpe.encode(part.column("text"))
            block = P.pack(tokens.astype(kind), np.asarray(part.column("id")), count.astype(np.uint32))
            numbers = (pa.array([x], pa.int64()) for x in (task, before, len(tokens)))
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([block], pa.binary())], ["task", "before", "n", "data"])
            before += len(tokens)

    return materialise(rows.mapInArrow(encode, "task long, before long, n long, data binary"), "shard-tokens", "none")


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Pieces of a byte buffer, not copied."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


PIECE = "slot long, start int, n int, tokens binary, ids array<long>"


def cut_pieces(data: bytes, offset: int, length: int, total: int, key: int, wanted) -> pa.RecordBatch | None:
    """Of one slice whose tokens begin at that place of the stream, the pieces in those slots that are wanted."""
    tokens, ids, count = P.unpack(data)
    ends = np.cumsum(count.astype(np.int64))
    first, last = offset // length, (offset + len(tokens) - 1) // length
    numbers = np.arange(first, last + 1)
    begin = np.maximum(numbers * length - offset, 0)  # in the slice
    stop = np.minimum((numbers + 1) * length - offset, len(tokens))
    slot = permute(numbers, total, key)
    use = np.flatnonzero(wanted(slot))
    if not len(use):
        return None
    slot, begin, stop, numbers = slot[use], begin[use], stop[use], numbers[use]
    # the documents of each piece, repeated ones beside each other once
    a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, stop - 1, side="right") + 1
    docs = ids[np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
    n = stop - begin
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    offsets = np.r_[0, np.cumsum(n)] * tokens.itemsize
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(b - a)].astype(np.int32)), pa.array(docs))
    start = begin + offset - numbers * length
    columns = [pa.array(slot), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), binaries(tokens[at], offsets), lists]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECE.split(", ")])


def write_shards(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    pattern: str = PATTERN, end: int = END, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, rounds: int = ROUNDS,
) -> DataFrame:
    """Writes the shards below the folder and returns a row for each sequence.

    Columns: slot, sequence (its number), shard, byte (where it begins in the shard), n_tokens (without fill), doc_ids (the
    documents that it has tokens of, in order, equal ids beside each other once; a null id is -1), sha256 of its bytes.  Null
    and empty texts are an end token.  Repeated rows come as often as they occur.  IDs are unsigned, 16 bits where all fit,
    little-endian.  An empty table writes no shard.  A text of any length is encoded whole.  Other columns aren't read,
    whatever their names.

    Documents are packed in the order in which the table is read, task by task, so the table's files and their order say
    which documents share a sequence.  A shard gets its name when it is complete; a task that is repeated writes the same
    bytes to the same name.  One number of each task that reads comes to the driver, and the vocabulary goes to the executors.
    """
    spark = docs.sparkSession
    kind = "<u2" if end < 1 << 16 else "<u4"
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.col(text_col).alias("text"))
    with open(vocabulary, "rb") as f:
        table = encoded(rows, f.read(), pattern, end, kind)
    tasks = sorted((r.task, r.n) for r in table.groupBy("task").agg(F.sum("n").alias("n")).collect())
    first = dict(zip((t for t, _ in tasks), np.r_[0, np.cumsum([n for _, n in tasks])].tolist()))
    tokens_in_all = sum(n for _, n in tasks)
    total = -(-tokens_in_all // length)
    shards = -(-total // per_shard)
    names = ["slot", "sequence", "shard", "byte", "n_tokens", "doc_ids", "sha256"]

    def deal(low: int, high: int):
        def read(batches):
            for batch in batches:
                for task, before, data in zip(*(batch.column(c).to_pylist() for c in ("task", "before", "data"))):
                    wanted = lambda slot: (slot >= low) & (slot < high)
                    if (got := cut_pieces(data, first[task] + before, length, total, key, wanted)) is not None:
                        yield got

        return read

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a range of shards come in the order of their slots."""
        import hashlib

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        size, blank = length * np.dtype(kind).itemsize, np.full(length, end, kind).tobytes()
        place, shard, done, held = None, None, [], []

        def finish():
            """The slot whose pieces are held."""
            n = sum(x[1] for x in held)
            data = b"".join(x[2] for x in held) + blank
            if held[0][0] or any(a[0] + a[1] != b[0] for a, b in zip(held, held[1:])):
                raise RuntimeError(f"slot {place} lacks a piece")
            ids = [i for x in held for i in x[3]]
            done.append((place, data[:size], n, [i for k, i in enumerate(ids) if not k or i != ids[k - 1]]))
            held.clear()

        def close():
            begin = shard * per_shard
            if [x[0] for x in done] != list(range(begin, min(begin + per_shard, total))):
                raise RuntimeError(f"shard {shard} doesn't have each of its slots once")
            name = posixpath.join(root, f"shard-{shard:08d}.bin")
            temporary = f"{name}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(temporary, compression=None) as f:
                for x in done:
                    f.write(x[1])
            store.move(temporary, name)
            at = np.array([x[0] for x in done], np.int64)
            used = [x[2] for x in done]
            columns = [at, permute(at, total, key, back=True), np.full(len(at), shard), (at - begin) * size, np.array(used, np.int64)]
            digests = pa.array([hashlib.sha256(x[1]).hexdigest() for x in done])
            ids = pa.array([x[3] for x in done], pa.list_(pa.int64()))
            done.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), ids, digests], names)

        for part in batches:
            for slot, *piece in zip(*(part.column(c).to_pylist() for c in ("slot", "start", "n", "tokens", "ids"))):
                if slot != place:
                    if held:
                        finish()
                    if shard is not None and slot // per_shard != shard:
                        yield close()
                    place, shard = slot, slot // per_shard
                held.append(piece)
        if held:
            finish()
            yield close()

    schema = "slot long, sequence long, shard long, byte long, n_tokens long, doc_ids array<long>, sha256 string"
    lists = []
    for k in range(rounds):
        low, high = k * shards // rounds, (k + 1) * shards // rounds
        if low < high:
            dealt = table.select("task", "before", "data").mapInArrow(deal(low * per_shard, high * per_shard), PIECE)
            # a partition is a range of slots: one shard, or several where there are very many
            several = -(-(high - low) // PARTITIONS_MOST)
            number = F.floor((F.floor(F.col("slot") / per_shard) - low) / several).cast("int")
            ranges = dealt.repartitionById(-(-(high - low) // several), number).sortWithinPartitions("slot", "start")
            lists.append(materialise(ranges.mapInArrow(write, schema), "shard-list"))
    drop_table(table)
    facts = spark.createDataFrame([(total, length, per_shard, kind, key, end)], "sequences long, length long, per_shard long, dtype string, key long, end long")
    facts.coalesce(1).write.mode("overwrite").json(f"{folder}/_facts")
    return reduce(DataFrame.unionByName, lists) if lists else spark.createDataFrame([], schema)


def read_sequences(folder: str, facts: dict, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens) of the slots from start on, in order: a reader resumes with the slot after its last."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    stride = facts["length"] * np.dtype(facts["dtype"]).itemsize
    stop = facts["sequences"] if stop is None else min(stop, facts["sequences"])
    slot = start
    while slot < stop:
        shard, within = divmod(slot, facts["per_shard"])
        with store.open_input_file(posixpath.join(root, f"shard-{shard:08d}.bin")) as f:
            f.seek(within * stride)
            while slot < stop and slot // facts["per_shard"] == shard:
                yield slot, np.frombuffer(f.read(stride), facts["dtype"])
                slot += 1


def token_shards(docs: DataFrame, **parameters) -> DataFrame:
    """`write_shards` into a new folder below the shared one."""
    return write_shards(docs, scratch(docs.sparkSession, "shards"), **parameters)
