r"""Fuzzy line deduplication: of each group of like lines in the whole corpus one occurrence stays.

Lines (between \\n) are normalised: lower case, words of letters only, single blanks. Equal normalised lines are one node.
Each node has a 64-bit SimHash of its distinct words. Nodes that differ in at most MOST_BITS bits agree in some blocks of the hash
(pigeonhole): with BLOCKS blocks, in at least BLOCKS - MOST_BITS of them, so each choice of that many blocks is a bucket
key. Pairs within a bucket whose hashes are close are verified by edit similarity, 1 - distance / longer length in
characters, at THRESHOLD or more, and linked lines form groups. A group keeps the occurrence with the smallest (doc_id, line).

The number of blocks follows the number of lines, so that keys stay selective (25 bits with five blocks, 32 with six, 36 with
seven); any choice finds the same pairs. Three bits of 64 alone find few of the like lines (see README), so the lines share
buckets by word shingles too: each line has as keys the SHINGLES smallest hashes of its three-word shingles, and a line of up
to FEW words also all its words without one of them. Pairs of a shingle's bucket need lengths that the threshold admits, and at most FAR_BITS bits of difference, MIDDLE_BITS
where one has up to MIDDLE words and any where one has up to LOOSE: where a word in eight differs, ten bits do on average, with a
deviation of three, so of pairs just at the threshold some are lost. What differs in case, digits or punctuation only is always found. Not found are like lines that share
none of these keys: a single word with another letter, two other words in a line of up to eight, or a changed letter in nearly
every third word.

How it moves little. Buckets are found in packed form: a task sorts the keys of its lines and sends one binary value a
partition of the key space, so a key costs 16 to 24 bytes and no row. The receiving task sorts a partition, and gives the pairs of
buckets of up to SMALL members; of larger ones it gives the members, which stars around changing centres settle (links.py).
Keys that more than HOT lines share, which a table of 2**20 counters of fixed size shows, never enter a partition: their
members go to the stars as rows. The pair tests are the same everywhere, so none of these sizes changes what is found. Only
lines of pairs that pass them are read again.

Only whole lines are compared: a passage that repeats inside lines whose other words differ stays.

Defined cases: lines without a letter (blank lines too) always stay; all others count, however short or long. Null text stays
null; empty text stays empty; a document that loses all lines has an empty text. Documents with a null or an equal doc_id are
told apart by their text; rows equal in both count as one document and are cleaned alike. Null doc_ids come last. An empty
table gives an empty table; extra columns pass through. Nodes are 64-bit hashes of the normalised line: among 1e11 lines
about 270 pairs fall together by chance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Shelf, checkpoint, fresh, release, table, tidy
from .edit_distance import similar
from .hashing import U, mix
from .links import bucket_classes, components, merged, tile_links

MOST_BITS = 3
FAR_BITS = 14
SHINGLES = 8
FEW = 13
MIDDLE, MIDDLE_BITS = 20, 18
LOOSE = 8
THRESHOLD = 0.85
SMALL = 64
WHOLE = 1 << 13
HOT = 1 << 17
COUNTERS = 1 << 20
#: Lines that a task sorts at once.
WINDOW = 1 << 16


def simhash(hashes: np.ndarray, starts: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """The SimHash of each run of word hashes; runs begin at `starts` and none is empty."""
    out = np.zeros(len(starts), U)
    at, ends = 0, np.append(starts[1:], len(hashes))
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, "right")))
        votes = np.zeros((to - at, 64), np.int64)
        for lo in range(starts[at], ends[to - 1], step):  # a run longer than a step adds up over several
            hi = min(lo + step, ends[to - 1])
            bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.searchsorted(starts, lo, "right") - 1
            last = np.searchsorted(starts, hi, "left")
            cuts = np.maximum(starts[first:last], lo) - lo
            votes[first - at : last - at] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        words = (ends - starts)[at:to, None]
        out[at:to] = np.packbits(2 * votes > words, axis=1, bitorder="little").view(U).reshape(-1)
        at = to
    return out


def distinct_words(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a run once, so that the few most common words of a language don't make long lines alike."""
    if len(starts) > 1 << 20:  # rows have 20 bits
        half = len(starts) // 2
        (h, s), (h2, s2) = distinct_words(hashes[: starts[half]], starts[:half]), distinct_words(hashes[starts[half] :], starts[half:] - starts[half])
        return np.concatenate([h, h2]), np.concatenate([s, s2 + len(h)])
    row = np.repeat(np.arange(len(starts), dtype=U), np.diff(np.append(starts, len(hashes))))
    x = np.sort((row << U(44)) | (hashes >> U(20)))
    x = x[np.append(True, x[1:] != x[:-1])]
    with np.errstate(over="ignore"):
        return mix(x & U((1 << 44) - 1)), np.searchsorted(x, np.arange(len(starts), dtype=U) << U(44))


def shingle_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the shingles' bucket keys of each run of word hashes, sorted and distinct; runs begin at `starts`. Keys have 44 bits."""
    if len(starts) > 1 << 20:  # rows have 20 bits below
        half = len(starts) // 2
        parts = [shingle_keys(hashes[: starts[half]], starts[:half]), shingle_keys(hashes[starts[half] :], starts[half:] - starts[half])]
        return np.concatenate([parts[0][0], parts[1][0] + half]), np.concatenate([parts[0][1], parts[1][1]])
    count = np.diff(np.append(starts, len(hashes)))
    row = np.repeat(np.arange(len(starts)), count)
    with np.errstate(over="ignore"):
        own = np.flatnonzero(row[:-2] == row[2:])
        acc = np.zeros(len(own), U)
        for k in range(3):
            acc = mix(acc * hashing._Q + hashes[own + k])
        x = np.sort((row[own].astype(U) << U(44)) | (acc >> U(20)))
        x = x[np.append(True, x[1:] != x[:-1])[: len(x)]]
        r = (x >> U(44)).astype(np.int64)
        least = np.arange(len(r)) - np.searchsorted(r, np.arange(len(starts)))[r] < SHINGLES
        # Short lines: the words without one of them, and all; as sums, the order doesn't matter.
        short = np.flatnonzero(count[row] <= FEW)
        rows = np.unique(row[short])
        spread = mix(hashes[short] ^ hashing._P)
        total = np.zeros(len(starts), U)
        np.add.at(total, row[short], spread)
        n = count.astype(U)
        less = mix(total[row[short]] - spread + (n[row[short]] - U(1)) * hashing._Q)[count[row[short]] > 1]
        rest = row[short][count[row[short]] > 1]
        full = mix(total[rows] + n[rows] * hashing._Q)
        x = np.sort(np.concatenate([x[least], (rest.astype(U) << U(44)) | (less >> U(20)), (rows.astype(U) << U(44)) | (full >> U(20))]))
    x = x[np.append(True, x[1:] != x[:-1])[: len(x)]]
    return (x >> U(44)).astype(np.int64), x & U((1 << 44) - 1)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lines_of(docs: DataFrame) -> DataFrame:
    """docs (dk, doc_id, text) -> (dk, doc_id, pos, node, sim, chars, words, keys) of each line with a letter; pos counts from 0. chars:
    of the normalised line; keys: six bytes each."""

    def run(it):
        for batch in it:
            for part in hashing.slices(batch, "text"):
                text = pc.utf8_lower(pc.fill_null(_column(part, "text"), ""))
                raw, offsets = hashing.text_bytes(text)
                breaks = np.flatnonzero(raw == 10)
                starts = np.union1d(offsets[:-1], breaks + 1)  # of lines; an empty text shares its start with the next one
                starts = starts[starts < len(raw)]
                if not len(starts):
                    continue
                doc = np.searchsorted(offsets, starts, "right") - 1
                # pos: breaks of the same document before the line.
                before = np.searchsorted(breaks, starts, "left") - np.searchsorted(breaks, offsets[doc], "left")
                hashes, w0, w1 = hashing.words(raw, offsets, hashing.NO_LETTER)
                begin = np.searchsorted(w0, np.append(starts, len(raw)))
                keep = np.flatnonzero(begin[1:] > begin[:-1])
                if not len(keep):
                    continue
                lo, hi = begin[:-1][keep], begin[1:][keep]  # words outside of lines don't exist, so lo[1:] == hi[:-1]
                with np.errstate(over="ignore"):
                    node = mix(hashing.ranges(hashes, lo, hi, hashing._Q, hashing._Q_INV) + (hi - lo).astype(U))
                sim = simhash(*distinct_words(hashes, lo))
                heads = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                long = np.append(0, np.cumsum(heads[w1] - heads[w0]))
                chars = long[hi] - long[lo] + hi - lo - 1
                rows, keys = shingle_keys(hashes, lo)
                six = np.ascontiguousarray((keys << U(4)).view(np.uint8).reshape(-1, 8)[:, :6])
                ends = (np.searchsorted(rows, np.arange(len(lo) + 1)) * 6).astype(np.int32)
                keys = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(ends), pa.py_buffer(six)])
                dk, ids = (_column(part, c).take(pa.array(doc[keep])) for c in ("dk", "doc_id"))
                yield pa.RecordBatch.from_arrays([dk, ids, pa.array(before[keep], pa.int32()), pa.array(node.view(np.int64)), pa.array(sim.view(np.int64)), pa.array(chars, pa.int32()), pa.array(hi - lo, pa.int32()), keys], names=["dk", "doc_id", "pos", "node", "sim", "chars", "words", "keys"])

    return docs.select("dk", F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "dk long, doc_id long, pos int, node long, sim long, chars int, words int, keys binary")


def n_blocks(nodes: int) -> int:
    return 5 if nodes < 1 << 27 else 6 if nodes < 1 << 34 else 7


def arranged(sim: np.ndarray, blocks: int, most: int = MOST_BITS):
    """For each choice of blocks - most blocks: (width, hashes with the bits of the choice moved to the top). A bucket key is the
    choice and those bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    for chosen in combinations(range(blocks), blocks - most):
        out, width = np.zeros(len(sim), U), 0
        for i in [*chosen, *(j for j in range(blocks) if j not in chosen)]:
            n = edges[i + 1] - edges[i]
            out = (out << U(n)) | ((sim >> U(edges[i])) & U((1 << n) - 1))
            width += n if i in chosen else 0
        yield width, out


SIM = np.dtype([("key", "<u8"), ("node", "<u8")])
SHINGLE = np.dtype([("key", "<u8"), ("node", "<u8"), ("sim", "<u8"), ("chars", "<u2"), ("words", "u1")])


def unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Arrays of a batch of lines; row: the line of each shingle key."""
    raw, offsets = hashing.text_bytes(_column(batch, "keys"))
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = raw.reshape(-1, 6)
    got = {c: _column(batch, c).to_numpy(zero_copy_only=False) for c in ("node", "sim", "chars", "words")}
    return {"node": got["node"].view(U), "sim": got["sim"].view(U), "chars": np.minimum(got["chars"], 65535), "words": np.minimum(got["words"], 255), "key": wide.view(U).reshape(-1), "row": np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 6)}


def windows(it):
    """Distinct nodes of about WINDOW lines at once."""
    held: list[dict] = []

    def merged():
        shift, rows = 0, []
        for x in held:
            rows.append(x["row"] + shift)
            shift += len(x["node"])
        got = {c: np.concatenate([x[c] for x in held]) for c in ("node", "sim", "chars", "words", "key")} | {"row": np.concatenate(rows)}
        first = np.zeros(shift, bool)
        first[np.unique(got["node"], return_index=True)[1]] = True
        keys = first[got["row"]]
        place = np.cumsum(first) - 1
        return {c: got[c][first] for c in ("node", "sim", "chars", "words")} | {"key": got["key"][keys], "row": place[got["row"][keys]]}

    size = 0
    for batch in it:
        held.append(unpacked(batch))
        size += batch.num_rows
        if size >= WINDOW:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


def counter_of(key: np.ndarray, width: int, choice: int) -> np.ndarray:
    """The counter of a bucket key: the top `width` bits of key, in choice `choice` (shingle keys: 48 bits at the bottom, choice -1)."""
    with np.errstate(over="ignore"):
        top = key >> U(64 - width) if choice >= 0 else key
        return (mix(top + U(choice + 2) * hashing._P) & U(COUNTERS - 1)).astype(np.int64)


def counted_keys(lines: DataFrame, blocks: int) -> np.ndarray:
    """COUNTERS counters of bucket keys, less the mean. As many numbers come to the driver, whatever the input."""
    parts = 64
    per = COUNTERS // parts

    def count(it):
        total = np.zeros(COUNTERS, np.int64)
        for w in windows(it):
            total += np.bincount(counter_of(w["key"], 0, -1), minlength=COUNTERS)
            for c, (width, key) in enumerate(arranged(w["sim"], blocks)):
                total += np.bincount(counter_of(key, width, c), minlength=COUNTERS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([total[i * per : (i + 1) * per].tobytes() for i in range(parts)], pa.binary())], names=["part", "counts"])

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for part, counts in zip(_column(batch, "part").to_pylist(), _column(batch, "counts")):
                sums.setdefault(part, np.zeros(per, np.int64))
                sums[part] += np.frombuffer(counts.as_buffer(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    total = np.zeros(COUNTERS, np.int64)
    for r in lines.select("node", "sim", "chars", "words", "keys").mapInArrow(tidy(count), kind).repartition("part").mapInArrow(tidy(add), kind).collect():
        total[r["part"] * per : (r["part"] + 1) * per] = np.frombuffer(r["counts"], np.int64)
    return total - total.sum() // COUNTERS


CANDIDATES = "kind int, a long, b long, chars int, key long, sim long, words int"


def _rows(kind: int, a, b=None, chars=None, key=None, sim=None, words=None) -> pa.RecordBatch:
    n = len(a)
    wide = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64)) if x is not None else pa.nulls(n, pa.int64())
    whole = lambda x: pa.array(x, pa.int32()) if x is not None else pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), wide(a), wide(b), whole(chars), wide(key), wide(sim), whole(words)], names=["kind", "a", "b", "chars", "key", "sim", "words"])


def packed_keys(lines: DataFrame, blocks: int, bits: int, hot: frozenset[int]) -> DataFrame:
    """lines -> (part, form, packed): the keys of distinct nodes, sorted, by choice or shingle (form -1) and the top `bits` bits; and,
    with part null, the members of keys whose counters are hot as rows of one."""

    def run(it):
        table = np.zeros(COUNTERS, bool)
        table[list(hot)] = True
        for w in windows(it):
            parts, forms, blobs = [], [], []

            def send(form, top, entries):
                order = np.argsort(entries["key"], kind="stable")
                entries, top = entries[order], top[order]
                cuts = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
                for lo, hi in zip(cuts, np.append(cuts[1:], len(top))):
                    # Byte planes: of sorted keys the upper ones repeat, and what moves is compressed.
                    blobs.append(np.ascontiguousarray(entries[lo:hi].view(np.uint8).reshape(hi - lo, -1).T).tobytes())
                    parts.append(int(top[lo]) + ((form + 1) << bits))
                    forms.append(form)

            for c, (width, key) in enumerate(arranged(w["sim"], blocks)):
                rare = ~table[counter_of(key, width, c)] if hot else np.ones(len(key), bool)
                e = np.empty(rare.sum(), SIM)
                e["key"], e["node"] = key[rare], w["node"][rare]
                if len(e):
                    send(c, e["key"] >> U(64 - bits), e)
            rare = ~table[counter_of(w["key"], 0, -1)] if hot else np.ones(len(w["key"]), bool)
            row = w["row"][rare]
            e = np.empty(len(row), SHINGLE)
            e["key"] = w["key"][rare]
            for c in ("node", "sim", "chars", "words"):
                e[c] = w[c][row]
            if len(e):
                send(-1, e["key"] >> U(48 - bits), e)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(forms, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "form", "packed"])

    return lines.select("node", "sim", "chars", "words", "keys").mapInArrow(tidy(run), "part int, form int, packed binary")


def hot_members(lines: DataFrame, blocks: int, hot: frozenset[int]) -> DataFrame:
    """Members (kind 2) of the keys whose counters are hot."""

    def run(it):
        table = np.zeros(COUNTERS, bool)
        table[list(hot)] = True
        for w in windows(it):
            for c, (width, key) in enumerate(arranged(w["sim"], blocks)):
                own = np.flatnonzero(table[counter_of(key, width, c)])
                if len(own):
                    yield _rows(2, w["node"][own], chars=w["chars"][own], key=bucket_key(key[own], width, c), sim=w["sim"][own], words=w["words"][own])
            own = np.flatnonzero(table[counter_of(w["key"], 0, -1)])
            if len(own):
                row = w["row"][own]
                yield _rows(2, w["node"][row], chars=w["chars"][row], key=bucket_key(w["key"][own], 0, -1), sim=w["sim"][row], words=w["words"][row])

    return lines.select("node", "sim", "chars", "words", "keys").mapInArrow(tidy(run), CANDIDATES)


def bucket_key(key: np.ndarray, width: int, choice: int) -> np.ndarray:
    """One number a bucket: those of shingles have the top bit."""
    return (key >> U(64 - width)) | U(choice << 57) if choice >= 0 else key | U(1 << 63)


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether lengths admit the threshold. 65535 stands for that and all more."""
    high = np.maximum(x, y)
    return (np.minimum(x, y) >= high - np.floor((1 - threshold) * high + 1e-9)) | (high == 65535) & (np.minimum(x, y) >= 55700 * (threshold >= 0.85))


def bucket_pairs(packed: DataFrame, blocks: int, bits: int, threshold: float) -> DataFrame:
    """CANDIDATES within partitions of keys: kind 0, the smallest member of a bucket with each other one; 1, other pairs of a bucket of
    up to SMALL members; 2, the members of a larger one."""

    def pairs(e, width, test, whole, form):
        """Of entries with a bucket in the top bits of their key (all bits for width 64)."""
        if not len(e):
            return
        shift = U(64 - width)
        e = e[np.argsort(e["key"])]
        bucket = e["key"] >> shift
        shared = np.append(False, bucket[1:] == bucket[:-1])
        e = e[shared | np.append(shared[1:], False)]
        node, bucket = e["node"].view(np.int64), e["key"] >> shift
        # By the node as a signed number, the order of links.py; a node of several windows comes once.
        order = np.lexsort((node, bucket))
        e, node, bucket = e[order], node[order], bucket[order]
        once = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))[: len(e)]
        e, bucket = e[once], bucket[once]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        size = np.diff(np.append(cuts, len(bucket)))
        many = np.repeat(size, size)
        first = np.arange(len(bucket)) - np.repeat(cuts, size)
        for lo in np.flatnonzero((many > SMALL) & (first == 0)):
            own = e[lo : lo + many[lo]]
            if len(own) <= WHOLE:  # those that no other member is like go
                ok = [(test(own[k : k + 64, None], own[None, :]) & (own["node"][k : k + 64, None] != own["node"][None, :])).any(axis=1) for k in range(0, len(own), 64)]
                own = own[np.concatenate(ok)]
            if len(own):
                yield whole(own, form)

        def tested(kind, one, two):
            x, y = e[one], e[two]
            ok = test(x, y)
            a, b = x["node"][ok].view(np.int64), y["node"][ok].view(np.int64)
            bits = np.bitwise_count((x["sim"] ^ y["sim"] if form < 0 else x["key"] ^ y["key"])[ok])
            return _rows(kind, np.minimum(a, b), np.maximum(a, b), words=bits.astype(np.int32))

        star = np.flatnonzero(first > 0)
        yield tested(0, star - first[star], star)
        small = (many <= SMALL) & (first > 0)
        for d in range(1, SMALL - 1):
            one = np.flatnonzero(small & (first + d < many))
            if not len(one):
                break
            yield tested(1, one, one + d)

    def by_sim(x, y):
        return np.bitwise_count(x["key"] ^ y["key"]) <= MOST_BITS

    def by_shingle(x, y):
        sized = near(x["chars"].astype(np.int64), y["chars"].astype(np.int64), threshold)
        words = np.minimum(x["words"], y["words"])
        return sized & ((np.bitwise_count(x["sim"] ^ y["sim"]) <= np.where(words <= MIDDLE, MIDDLE_BITS, FAR_BITS)) | (words <= LOOSE))

    def run(it):
        held: dict[tuple[int, int], list] = {}
        for batch in it:
            for part, form, blob in zip(_column(batch, "part").to_pylist(), _column(batch, "form").to_pylist(), _column(batch, "packed")):
                kind = SHINGLE if form < 0 else SIM
                planes = np.frombuffer(blob.as_buffer(), np.uint8).reshape(kind.itemsize, -1)
                held.setdefault((form, part), []).append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        widths = [w for w, _ in arranged(np.zeros(0, U), blocks)]
        for (form, part) in list(held):
            e = np.concatenate(held.pop((form, part)))
            width = widths[form] if form >= 0 else 64
            if form < 0:
                yield from pairs(e, width, by_shingle, lambda x, f: _rows(2, x["node"].copy(), chars=x["chars"].astype(np.int32), key=bucket_key(x["key"], 0, -1), sim=x["sim"].copy(), words=x["words"].astype(np.int32)), form)
            else:
                yield from pairs(e, width, by_sim, lambda x, f, w=width: _rows(2, x["node"].copy(), key=bucket_key(x["key"], w, f), sim=restored(x["key"], blocks, f)), form)

    return packed.mapInArrow(tidy(run), CANDIDATES)


def restored(key: np.ndarray, blocks: int, choice: int, most: int = MOST_BITS) -> np.ndarray:
    """The hashes whose bits `arranged` moved."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    chosen = list(combinations(range(blocks), blocks - most))[choice]
    out, at = np.zeros(len(key), U), 64
    for i in [*chosen, *(j for j in range(blocks) if j not in chosen)]:
        n = edges[i + 1] - edges[i]
        at -= n
        out |= ((key >> U(at)) & U((1 << n) - 1)) << U(edges[i])
    return out


def alike(x, y, threshold: float):
    """Whether two nodes of a bucket may be like: sketches (sim, chars, words, shingle) that don't rule it out."""
    bits = F.bit_count(x["sim"].bitwiseXOR(y["sim"]))
    high, low, words = F.greatest(x["chars"], y["chars"]), F.least(x["chars"], y["chars"]), F.least(x["words"], y["words"])
    sized = (low >= high - F.floor((1 - threshold) * high + 1e-9)) | ((high == 65535) & (low >= (55700 if threshold >= 0.85 else 0)))
    return (~x["shingle"] & (bits <= MOST_BITS)) | (x["shingle"] & sized & ((bits <= F.when(words <= MIDDLE, MIDDLE_BITS).otherwise(FAR_BITS)) | (words <= LOOSE)))


def candidates(lines: DataFrame, n: int, threshold: float) -> tuple[DataFrame, bool]:
    """CANDIDATES of all lines, n of them, and whether there are hot keys, of which only members are given."""
    blocks = n_blocks(n)
    counts = counted_keys(lines, blocks)
    hot = frozenset(np.flatnonzero(counts > HOT).tolist())
    # About half a million keys a partition; parts are a sixteenth of what one form has for it.
    keys = n * (SHINGLES + len(list(combinations(range(blocks), blocks - MOST_BITS))))
    tasks = max(8, keys >> 19)
    bits = max(4, (n * SHINGLES >> 17).bit_length())
    packed = packed_keys(lines, blocks, bits, hot)
    found = bucket_pairs(packed.repartition(tasks, "part").select("part", "form", "packed"), blocks, bits, threshold)
    return (found.unionByName(hot_members(lines, blocks, hot)), True) if hot else (found, False)


def normal_lines(lines: list[str]) -> pa.Array:
    """Lines as they are compared."""
    lower = pc.utf8_lower(pa.array(lines, pa.string()))
    return pc.utf8_trim(pc.replace_substring_regex(lower, r"[\x00-`{-\x7f]+", " "), " ")


def edit_pairs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose lines (node, line) have the edit similarity."""
    one, two = (texts.select(F.col("node").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")

    def run(it):
        held: list[pa.RecordBatch] = []
        for batch in it:
            held.append(batch)
            if sum(x.nbytes for x in held) > 1 << 23:
                yield found(held)
                held = []
        if held:
            yield found(held)

    def found(held):
        a, b, la, lb = (pa.chunked_array([_column(x, c) for x in held]).combine_chunks() for c in ("a", "b", "la", "lb"))
        ok = pa.array(similar(la.to_pylist(), lb.to_pylist(), threshold))
        return pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "la", "lb").mapInArrow(tidy(run), "a long, b long")


def maybe_similar(tile: pa.Table, threshold: float):
    """(row, other rows) -> which others may have the edit similarity to the row, for rows (key, sketch, line, keys) of one bucket. A pair
    is compared in the smallest bucket that both are in; those of shingles come first, and their test lets all pairs through that the other's does."""
    sketch = tile["sketch"].combine_chunks()
    sim, words = sketch.field("sim").to_numpy().view(U), sketch.field("words").fill_null(0).to_numpy()
    key, shingle = tile["key"][0].as_py(), sketch.field("shingle")[0].as_py()
    lines, n = tile["line"].to_pylist(), tile.num_rows
    smaller = [frozenset(k for k in own if k < key) for own in tile["keys"].to_pylist()]
    chars = np.array([len(x) for x in lines])
    # Pairs of letters, thrown into 64 counters: an edit changes two of either line at most.
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(n), chars)
    both = np.flatnonzero(row[1:] == row[:-1])
    profile = np.bincount(row[both] * 64 + ((code[both] * np.uint32(37) + code[both + 1] * np.uint32(11)) & np.uint32(63)), minlength=64 * n).reshape(n, 64).astype(np.int32)
    step, held = max(1, (1 << 15) // n), [-1, None]

    def alike_rows(lo):
        """Rows lo .. lo + step against all: what sketches and lengths say."""
        own = slice(lo, lo + step)
        bits = np.bitwise_count(sim[own, None] ^ sim)
        ok = abs(chars[own, None] - chars) <= np.floor((1 - threshold) * np.maximum(chars[own, None], chars) + 1e-9)
        if not shingle:
            return ok & (bits <= MOST_BITS)
        least = np.minimum(words[own, None], words)
        return ok & ((bits <= np.where(least <= MIDDLE, MIDDLE_BITS, FAR_BITS)) | (least <= LOOSE))

    def linked(i, others):
        if held[0] != i // step:
            held[:] = i // step, alike_rows(i // step * step)
        some = np.flatnonzero(held[1][i % step][others])
        if len(some):
            most = np.floor((1 - threshold) * np.maximum(chars[others[some]], chars[i]) + 1e-9)
            some = some[abs(profile[others[some]] - profile[i]).sum(axis=1) <= 4 * most]
        if smaller[i]:
            some = np.array([k for k in some.tolist() if smaller[i].isdisjoint(smaller[others[k]])], np.int64)
        return some

    return linked


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs (dk, text) -> (dk, packed): texts compressed one by one, to move less than Spark's own block compression does."""

    def run(it):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in it:
            for part in hashing.slices(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                packed = pa.array([squeeze.compress(t.encode()) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("dk")), packed], names=["dk", "packed"])

    return docs.select("dk", "text").mapInArrow(tidy(run), "dk long, packed binary")


def picked_lines(packed: DataFrame) -> DataFrame:
    """(packed, want array<struct<node, pos>>) -> (node, line) of the lines wanted, normalised."""

    def run(it):
        import zstandard

        release = zstandard.ZstdDecompressor()
        for batch in it:
            nodes, lines, size = [], [], 0
            for raw, want in zip(batch.column(0), batch.column(1)):
                own = release.decompress(raw.as_py()).decode().split("\n")
                for w in want.as_py():
                    nodes.append(w["node"])
                    lines.append(own[w["pos"]])
                    size += len(lines[-1])
                if size > 1 << 20:
                    yield made(nodes, lines)
                    nodes, lines, size = [], [], 0
            yield made(nodes, lines)

    def made(nodes, lines):
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), normal_lines(lines)], names=["node", "line"])

    return packed.select("packed", "want").mapInArrow(tidy(run), "node long, line string")


def linked(keyed: DataFrame, lines: DataFrame, nodes: DataFrame, n: int, threshold: float, shelf: Shelf) -> DataFrame | None:
    """(node, class) of the nodes that are like others; None if there are none."""
    spark = keyed.sparkSession
    found, hot = candidates(lines, n, threshold)
    found = shelf.put("candidates", found)
    release(spark)
    members = found.where("kind = 2").select("key", F.col("a").alias("node"), F.struct("sim", "chars", "words", (F.col("key") < 0).alias("shingle")).alias("sketch"))
    pairs = checkpoint(found.where("kind < 2").groupBy("a", "b").agg(F.min("kind").alias("kind")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    wanted = ends.join(nodes, "node").groupBy("at.dk").agg(F.collect_list(F.struct("node", "at.pos")).alias("want"))
    got = picked_lines(packed_texts(keyed).groupBy("dk").agg(F.first("packed").alias("packed")).join(wanted, "dk"))
    texts = shelf.put("texts", got)
    release(spark)
    classes = components(checkpoint(edit_pairs(pairs.where("kind = 0").select("a", "b"), texts, threshold)))
    # Pairs whose nodes lie in one class already need no look.
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(x), F.col("class").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    classes = merged(classes, checkpoint(edit_pairs(pairs.where("kind = 1 AND ca <> cb").select("a", "b"), texts, threshold)))
    release(spark)
    # A node comes once a key: parts hold distinct ones, hot keys may come from several windows.
    members = members.dropDuplicates(["key", "node"]) if hot else members

    def settle(held):
        keys = held.groupBy("node").agg(F.collect_list("key").alias("keys"))
        data = shelf.put("settled", texts.join(keys, "node").withColumn("size", 4 * F.length("line") + 8 * F.size("keys") + 256))
        return tile_links(held, data, lambda tile: maybe_similar(tile, threshold), lambda x, y: similar(x, y, threshold))

    return bucket_classes(members, lambda p: edit_pairs(p, texts, threshold), lambda x, y: alike(x, y, threshold), settle, classes=classes)


def _marked(docs: DataFrame, dk: str, pos: str, threshold: float) -> DataFrame:
    """docs with dk (a number for doc_id and text) and pos (array of the lines to remove, null for none)."""
    spark = docs.sparkSession
    docs = docs.withColumn(dk, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    keyed = docs.where("text IS NOT NULL").select(F.col(dk).alias("dk"), "doc_id", "text")
    shelf = Shelf(spark)
    try:
        lines = shelf.put("lines", lines_of(keyed))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dk", "pos")
        nodes = checkpoint(lines.groupBy("node").agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n")))
        release(spark)
        classes = linked(keyed, lines, nodes, nodes.count(), threshold, shelf)
        # What a node's occurrences give way to: the first of its class, or its own first if there are several.
        firsts = nodes.where("n > 1").select("node", "at")
        if classes is not None:
            classed = checkpoint(classes.join(nodes.select("node", "at"), "node"))
            of_class = classed.groupBy("class").agg(F.min("at").alias("at"))
            firsts = firsts.join(classed.select("node"), "node", "left_anti").unionByName(classed.select("node", "class").join(of_class, "class").select("node", "at"))
        gone = lines.select("dk", "doc_id", "pos", "node").join(firsts, "node").where("NOT (dk = at.dk AND pos = at.pos)").select("dk", "pos")
        gone = checkpoint(gone.groupBy("dk").agg(F.collect_list("pos").alias("gone")))
    finally:
        shelf.clear()
    release(spark)
    gone = gone.select(F.col("dk").alias(f"{dk}_"), F.col("gone").alias(pos))
    return docs.join(gone, F.col(dk) == F.col(f"{dk}_"), "left").drop(f"{dk}_")


_KEEP = "CASE WHEN {pos} IS NULL THEN {text} ELSE transform(array(split({text}, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), {pos}), i -> l[i]), '\\n'))[0] END"


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the removed lines; n_chars, where there is one, follows the text."""
    names = docs.columns
    dk, pos = fresh([*names, "dk", "pos"], "dk", "pos")
    marked = _marked(docs, dk, pos, threshold).withColumn("text", F.expr(_KEEP.format(pos=f"`{pos}`", text="text")))
    new = {"n_chars": F.length("text").cast("long")}
    return marked.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, n_removed, removed (sorted positions), text (what stays)."""
    marked = _marked(docs.select("doc_id", "text"), "dk", "pos", threshold)
    gone = F.coalesce(F.array_sort("pos"), F.array().cast("array<int>"))
    return marked.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"), F.expr(_KEEP.format(pos="pos", text="text")).alias("text"))


def op9_line_dedup(spark, sf_dir):
    return removed_lines(table(spark, sf_dir, "documents"))
