"""Token ids packed into rows of fixed length by best-fit decreasing.

Texts are tokenised in byte-bounded batches; a document longer than a row is split into pieces of at most LENGTH tokens,
losing none. Pieces are spread over shards by a hash of id, tokens and, among equal pieces of a task, number, so that neither
null ids nor repeated rows fill one shard; a shard holds about SHARD tokens whatever the size of the table, is
packed in one task and needs no other. Within a shard pieces go in order of decreasing length into the row with the
least room that still holds them; a segment tree over rooms finds that row in the logarithm of LENGTH.

A row has its ids (little-endian, 2 bytes each if the vocabulary allows, else 4), the cumulative lengths of its
segments, and for each segment the document, the piece and the position its position ids start from: position ids reset
to 0 at every segment (a later piece of a split document too, as attention doesn't cross rows). write_packed() writes the
matrices as .npy files.

Defined cases: null and empty texts have no tokens and are in no row. A null doc_id stays null. Rows that repeat are
packed as often. White space in runs of over BLANKS is encoded in parts. Special tokens written in a text are ordinary text. An empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import table

LENGTH = 2048
SHARD = 1 << 21
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Mean tokens in a byte of text, rounded up; it only sets the number of shards.
TOKENS_PER_BYTE = 0.5


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    """A byte-level BPE from a ranks file; built once in a process."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: White space that is encoded at once: the pattern's look-ahead recurs once a character, and a run of a million ends the worker.
BLANKS = 4096
_LONG_BLANKS = re.compile(rf"\s{{{BLANKS + 1},}}")


def encoded(tok, text: str) -> list[int]:
    """Token ids; runs of over BLANKS white-space characters are cut, their last character stays with what follows."""
    ids, at = [], 0
    for m in _LONG_BLANKS.finditer(text):
        ids += tok.encode_ordinary(text[at : m.start()])
        at = m.end() - 1
        for lo in range(m.start(), at, BLANKS):
            ids += tok.encode_ordinary(text[lo : min(lo + BLANKS, at)])
    return ids + tok.encode_ordinary(text[at:])


class RoomTree:
    """Rows by room: a segment tree over rooms 0..size that answers `the least room of at least n that some row has`."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.some = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.base + room
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the best fit, removed; None if no row has the room."""
        at, some = self.base + need, self.some
        if need >= len(self.rows):
            return None
        while not some[at]:  # up, to the first subtree right of here that has a row
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.base:
            at = 2 * at + (not some[2 * at])
        room = at - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            some[at] = 0
            at >>= 1
            while at and not (some[2 * at] or some[2 * at + 1]):
                some[at] = 0
                at >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of item positions. Items of equal length keep their order."""
    order = np.argsort(-lengths, kind="stable")
    rows: list[list[int]] = []
    tree = RoomTree(size)
    for i in order.tolist():
        n = int(lengths[i])
        if n > size:
            raise ValueError(f"an item of {n} doesn't fit into {size}")
        got = tree.take(n)
        if got is None:
            room, row = size, len(rows)
            rows.append([])
        else:
            room, row = got
        rows[row].append(i)
        if room > n:
            tree.add(room - n, row)
    return rows


def tokenised(docs: DataFrame, shards: int, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int | None = END) -> DataFrame:
    """docs (doc_id, text) -> (shard, doc_id, piece, n, ids): pieces of at most `length` tokens; `end` closes a document."""

    def run(it):
        import zlib

        tok = encoder(vocabulary)
        seen: Counter[int] = Counter()
        kind = np.uint16 if tok.max_token_value < 65536 and (end or 0) < 65536 else np.uint32
        for batch in it:
            for part in hashing.slices(batch, "text"):
                out: dict[str, list] = {"shard": [], "doc_id": [], "piece": [], "n": [], "ids": []}
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                for doc, text in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), texts):
                    if not text:
                        continue
                    ids = encoded(tok, text)
                    if end is not None:
                        ids.append(end)
                    ids = np.array(ids, kind)
                    for k, at in enumerate(range(0, len(ids), length)):
                        own = ids[at : at + length]
                        key = zlib.crc32(own.tobytes(), zlib.crc32(f"{doc}:{k}".encode()))
                        seen[key] += 1
                        out["shard"].append(zlib.crc32(str(seen[key]).encode(), key) % shards)
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["n"].append(len(own))
                        out["ids"].append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["ids"], pa.binary())], names=list(out))

    return docs.select("doc_id", "text").mapInArrow(run, "shard long, doc_id long, piece int, n int, ids binary")


_PACKED = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32()))])


def _pack_shard(pieces: pa.Table, length: int) -> pa.Table:
    """One shard. Pieces are put in a fixed order first, so that the outcome doesn't depend on how they came."""
    pieces = pieces.combine_chunks().sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
    lengths = np.asarray(pieces["n"])
    docs, numbers, ids = pieces["doc_id"].to_pylist(), pieces["piece"].to_pylist(), pieces["ids"]
    out: dict[str, list] = {f.name: [] for f in _PACKED}
    shard = pieces["shard"][0].as_py() if len(pieces) else 0
    for row, items in enumerate(best_fit_decreasing(lengths, length)):
        ends = np.cumsum(lengths[items])
        out["shard"].append(shard)
        out["row"].append(row)
        out["n_tokens"].append(int(ends[-1]))
        out["ids"].append(b"".join(ids[i].as_py() for i in items))
        out["cu_seqlens"].append([0, *ends.tolist()])
        out["doc_ids"].append([docs[i] for i in items])
        out["pieces"].append([numbers[i] for i in items])
        out["position_resets"].append([0, *ends[:-1].tolist()])
    return pa.table(out, schema=_PACKED)


def pack(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, vocabulary: str = VOCABULARY, end: int | None = END) -> DataFrame:
    """One row per packed row. The number of shards follows the text's bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, round(size * TOKENS_PER_BYTE / shard))
    kind = "shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, position_resets array<int>"
    return tokenised(docs, shards, length, vocabulary, end).groupBy("shard").applyInArrow(lambda t: _pack_shard(t, length), kind)


def position_ids(resets: list[int], n: int) -> np.ndarray:
    """0, 1, 2, ... that starts again at every reset."""
    at = np.zeros(n, np.int32)
    starts = np.asarray(resets, np.int64)
    at[starts[1:]] = np.diff(starts)
    return np.arange(n, dtype=np.int32) - np.cumsum(at)


def write_packed(packed: DataFrame, path: str, length: int = LENGTH, pad: int = END, id_bytes: int = 2) -> DataFrame:
    """Write each shard's rows below `path`, a folder that all executors mount: ids-S.npy and positions-S.npy (rows x
    length, padded), cu_seqlens-S.npy (all rows' one after the other) and cu_offsets-S.npy (where each row's begin).

    A shard's files are renamed into place, so a task that runs again replaces them. Returns shard, rows, tokens.
    """

    def write(t: pa.Table) -> pa.Table:
        import os
        import uuid

        t = t.combine_chunks().sort_by("row")
        n, shard_ = len(t), t["shard"][0].as_py()
        kind = np.uint16 if id_bytes == 2 else np.uint32
        ids, positions = np.full((n, length), pad, kind), np.zeros((n, length), np.int32)
        for i, (raw, resets) in enumerate(zip(t["ids"].to_pylist(), t["position_resets"].to_pylist())):
            own = np.frombuffer(raw, kind)
            ids[i, : len(own)] = own
            positions[i, : len(own)] = position_ids(resets, len(own))
        cu = t["cu_seqlens"].to_pylist()
        os.makedirs(path, exist_ok=True)
        for name, value in (("ids", ids), ("positions", positions), ("cu_seqlens", np.array([x for c in cu for x in c], np.int32)), ("cu_offsets", np.append(0, np.cumsum([len(c) for c in cu])))):
            held = f"{path}/.{name}-{shard_}-{uuid.uuid4().hex}"
            with open(held, "wb") as f:
                np.save(f, value)
            os.replace(held, f"{path}/{name}-{shard_:06d}.npy")
        return pa.table({"shard": pa.array([shard_], pa.int64()), "rows": pa.array([n], pa.int64()), "tokens": pa.array([sum(t["n_tokens"].to_pylist())], pa.int64())})

    return packed.groupBy("shard").applyInArrow(write, "shard long, rows long, tokens long")


def unpack(rows: Iterator, id_bytes: int = 2) -> dict:
    """(doc_id, piece) -> ids of packed rows; for checks."""
    kind, found = np.uint16 if id_bytes == 2 else np.uint32, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), kind)
        for lo, hi, doc, piece in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["pieces"]):
            found.setdefault((doc, piece), []).append(ids[lo:hi].tolist())
    return found


def op1_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
