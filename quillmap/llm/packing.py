"""Token-ID output: best-fit-decreasing packing of tokenised documents into fixed-length rows."""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

#: Row length in tokens, and tokens that a task gathers before it packs them.
ROW_TOKENS, SHARD_TOKENS = 2048, 4_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_VOCABULARY_LIMIT = 64 << 20
#: Characters that are encoded at once; longer texts are cut in front of a space, where tokens end anyway.
_ENCODE_CHARS = 100_000
SCHEMA = "shard long, row long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"


class CapacityTree:
    """Open rows by the room they have left; finds the least room that is enough, in log steps.

    A segment tree over rooms 0..capacity: each node counts the open rows beneath it.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Row and room of the tightest fit, which leaves the tree."""
        i, count = need + self.leaves, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i *= 2
            if not count[i]:
                i += 1
        room = i - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every piece of 1..capacity goes, longest first, where least room is left over."""
    tree, rows = CapacityTree(capacity), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[piece])
        found = tree.take(size)
        if found is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row, room = found
        rows[row].append(piece)
        if room > size:
            tree.put(row, room - size)
    return rows


def _cut(text: str):
    """Parts of a long text, cut in front of single spaces between letters, where no token spans."""
    i = 0
    while len(text) - i > _ENCODE_CHARS:
        j = text.find(" ", i + _ENCODE_CHARS)
        while j > 0 and not (text[j - 1].isalpha() and text[j + 1 : j + 2].isalpha()):
            j = text.find(" ", j + 1)
        if j < 0:
            break
        yield text[i:j]
        i = j
    yield text[i:]


def byte_pair_encoder(vocabulary: bytes):
    """text -> token ids under a ranks file ("base64 id" lines)."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) <= _ENCODE_CHARS:
            return encoding.encode_ordinary(text)
        return [t for part in _cut(text) for t in encoding.encode_ordinary(part)]

    return encode


def _rows(shard: int, pieces: list[tuple], tokens: list[np.ndarray], capacity: int, kind, pad: int) -> pa.RecordBatch:
    lengths = np.array([len(t) for t in tokens], np.int64)
    out = {k: [] for k in ("shard", "row", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "doc_starts")}
    for n, row in enumerate(best_fit_decreasing(lengths, capacity)):
        ends = np.concatenate([[0], np.cumsum(lengths[row])])
        ids, positions = np.full(capacity, pad, kind), np.zeros(capacity, kind)
        ids[: ends[-1]] = np.concatenate([tokens[i] for i in row])
        positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths[row])
        for k, v in zip(out, (shard, n, ends[-1], ids.tobytes(), positions.tobytes(), ends, [pieces[i][0] for i in row], [pieces[i][1] for i in row])):
            out[k].append(v)
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, vocabulary: str = VOCABULARY, end: int | None = END_OF_TEXT, pad: int = END_OF_TEXT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows of the packed id matrices of ``docs`` (doc_id, text; others ignored).

    ``ids`` and ``positions`` are little-endian matrices' rows of ``row_tokens`` entries (16 bits if
    ids and positions allow, else 32), padded with ``pad`` and 0; ``cu_seqlens`` are the cumulative
    segment lengths from 0, ``positions`` restarts at each segment, and segment i holds tokens of
    ``doc_ids[i]`` from its token ``doc_starts[i]`` on. Texts longer than a row are split into whole
    rows and a rest, so nothing is lost: a document's segments by doc_starts are its tokens and
    ``end`` (None: no end token). A null text gives nothing, an empty one its end token alone.
    Repeated rows are packed once each, segments of one length in order of arrival, a null doc_id is kept as null, and no rows give no rows. A task packs its documents a
    shard of about ``shard_tokens`` at a time, so memory is bounded and nothing is shuffled; (shard,
    row) names a matrix row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if os.path.getsize(vocabulary) > _VOCABULARY_LIMIT:
        raise ValueError(f"{vocabulary}: larger than {_VOCABULARY_LIMIT} bytes")
    with open(vocabulary, "rb") as f:
        content = f.read()
    shared = spark.sparkContext.broadcast(content)
    size = max(int(line.split()[1]) for line in content.splitlines() if line)
    kind = np.dtype("<u2") if max(size, end or 0, pad, row_tokens) < 1 << 16 else np.dtype("<u4")

    def run(batches):
        from pyspark import TaskContext

        encode = byte_pair_encoder(shared.value)
        shard, pieces, tokens, held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            packed = _rows(shard, pieces, tokens, row_tokens, kind, pad)
            for i in range(0, packed.num_rows, 256):
                yield packed.slice(i, 256)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                text = texts[i].as_py()
                if text is None:
                    continue
                t = np.array(encode(text) + ([] if end is None else [end]), kind)
                for a in range(0, len(t), row_tokens):
                    pieces.append((doc_id, a))
                    tokens.append(t[a : a + row_tokens])
                    held += len(tokens[-1])
                    if held >= shard_tokens:
                        yield from flush()
                        shard, pieces, tokens, held = shard + 1, [], [], 0
        if pieces:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def matrices(rows: list, row_tokens: int = ROW_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Id and position matrices of collected rows."""
    take = lambda c: np.stack([np.frombuffer(r[c], np.dtype(f"<u{len(r[c]) // row_tokens}")) for r in rows])
    return take("ids"), take("positions")


def op8_token_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
