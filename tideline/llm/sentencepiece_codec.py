"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; its few fields are read here by hand. From them the tokenizer is rebuilt: the character map
of the normaliser, white space turned into the metaspace marker with a dummy prefix, unigram scores or byte-pair merges
(in the order of the merged pieces' scores), and byte fallback for characters without a piece. No piece of a model holds
the marker behind another character, so a text may be cut before each run of markers without changing its pieces; that
keeps the merging linear in very long texts.

The same holds of the words of a batch: each distinct one is encoded once. Texts are encoded in batches bounded by bytes, with as many threads as `threads` says.

Defined cases: null stays null (ids, round_trip and parity are null, n_tokens is 0); the empty text has no ids. Rows that repeat are encoded alike;
extra columns pass through where the caller keeps them. An empty table gives an empty table. Whole texts are encoded.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import table, tidy

MARK = "▁"
#: Types of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BATCH_BYTES = 1 << 20
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        if n is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            n = varint()
        yield number, raw[at : at + n]
        at += n


def parse_model(raw: bytes) -> dict:
    """pieces [(text, score, type)], model_type, byte_fallback, unk_id, charsmap, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces."""
    model = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True, "split_by_whitespace": True, "whitespace_as_suffix": False}
    for number, value in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            model["pieces"].append((piece, score, kind))
        elif number == 2:
            names = {3: "model_type", 22: "split_by_whitespace", 24: "whitespace_as_suffix", 35: "byte_fallback", 40: "unk_id"}
            for k, v in fields(value):
                if k in names:
                    model[names[k]] = v
        elif number == 3:
            names = {2: "charsmap", 3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}
            for k, v in fields(value):
                if k in names:
                    model[names[k]] = v
    return model


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs to merge, best first. Every way to cut a piece into two others is a merge; pieces rank by score, and the
    cuts of one piece by the ids of their parts."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, score, kind in pieces:
        if kind != NORMAL or len(piece) < 2:
            continue
        cuts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        found += [(-score, ids[piece], *sorted((ids[a], ids[b])), a, b) for a, b in cuts]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: dict):
    """The tokenizers.Tokenizer of a parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if not model["escape_whitespaces"] or model["whitespace_as_suffix"]:
        raise ValueError("only models that mark white space in front of a word are supported")
    pieces = model["pieces"]
    unk = pieces[model["unk_id"]][0]
    if model["model_type"] == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        inner = models.BPE(vocab=vocab, merges=merges_of(pieces), unk_token=unk, fuse_unk=True, byte_fallback=bool(model["byte_fallback"]))
    elif model["model_type"] == UNIGRAM:
        low = min((s for _, s, k in pieces if k == NORMAL), default=0.0)
        # Pieces that may never be chosen for ordinary text get a score far below all others.
        scores = [(p, s if k in (NORMAL, USER) else low - 1e4) for p, s, k in pieces]
        inner = models.Unigram(scores, unk_id=model["unk_id"], byte_fallback=bool(model["byte_fallback"]))
    else:
        raise ValueError(f"model type {model['model_type']} is not supported")
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["remove_extra_whitespaces"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["add_dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(inner)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tail = [decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model["add_dummy_prefix"] else [])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), *tail])
    return tokenizer


@lru_cache(maxsize=2)
def codec(path: str):
    """The tokenizer of a model file; built once in a process."""
    with open(path, "rb") as f:
        return build(parse_model(f.read()))


@lru_cache(maxsize=2)
def encoder(path: str):
    """texts -> their encodings by codec(). Where white space is all that the model's normaliser changes, that is done here by
    Python, which costs a small part of what the normaliser's bookkeeping of positions does."""
    with open(path, "rb") as f:
        model = parse_model(f.read())
    tokenizer, lead = build(model), MARK if model["add_dummy_prefix"] else ""
    if model["charsmap"] or model["remove_extra_whitespaces"]:
        return lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    tokenizer.normalizer = None
    return lambda texts: tokenizer.encode_batch_fast([lead + t.replace(" ", MARK) if t else t for t in texts], add_special_tokens=False)


#: Words whose ids a process keeps, and the most characters of one.
KEPT_WORDS, KEPT_CHARS = 1 << 18, 40


@lru_cache(maxsize=2)
def word_encoder(path: str):
    """texts -> (array of its ids, those of encoder(); whether they are known to decode to the text) of each. Pieces never cross the start of a word, so where single blanks part the
    words, each distinct word of a batch is encoded once, and the first KEPT_WORDS of a process once for all batches."""
    with open(path, "rb") as f:
        model = parse_model(f.read())
    whole, pieces = encoder(path), [p for p, _, _ in model["pieces"]]
    if model["charsmap"] or model["remove_extra_whitespaces"] or not model["add_dummy_prefix"] or MARK not in pieces or any(MARK in p.lstrip(MARK) for p in pieces):
        return lambda texts: [(np.array(e.ids, np.int32), False) for e in whole(texts)]
    stands_for = piece_bytes(path).__getitem__
    begins = np.array([p[:1] == MARK for p in pieces])
    # Ids as bytes: of many lists Python's garbage collector would look at each. A blank at a text's end is a word of the marker only.
    known = {"": np.array([pieces.index(MARK)], np.int32).tobytes()}

    def encoded(texts):
        parted = [t.split(" ") if t and t[0] != " " and "  " not in t and MARK not in t else None for t in texts]
        new = list(set().union(*(ws for ws in parted if ws)).difference(known))
        if new:
            # As a few texts; a word begins where a piece with the marker does.
            ids = np.concatenate([np.array(e.ids, np.int32) for e in whole([" ".join(new[k : k + 4096]) for k in range(0, len(new), 4096)])])
            # What words decode to, a text of them does.
            if b"".join(map(stands_for, ids.tolist())) != (" " + " ".join(new)).encode():
                return [(np.array(e.ids, np.int32), False) for e in whole(texts)]
            cuts, raw = np.append(np.flatnonzero(begins[ids]) * 4, len(ids) * 4).tolist(), ids.tobytes()
            known.update((w, raw[lo:hi]) for w, lo, hi in zip(new, cuts[:-1], cuts[1:], strict=True))
        rest = iter(whole([t for t, ws in zip(texts, parted) if ws is None]))
        out = [(np.array(next(rest).ids, np.int32), False) if ws is None else (np.frombuffer(b"".join(map(known.__getitem__, ws)), np.int32), True) for ws in parted]
        if len(known) > KEPT_WORDS or max(map(len, new), default=0) > KEPT_CHARS:
            kept = [w for w in new if len(w) <= KEPT_CHARS][: max(0, KEPT_WORDS - len(known) + len(new))]
            for w in set(new).difference(kept):
                del known[w]
        return out

    return encoded


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """What each id stands for in a text: joined, the pieces of an encoding give its normalised text."""
    with open(path, "rb") as f:
        pieces = parse_model(f.read())["pieces"]
    return [bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in pieces]


def decode(ids: list[list[int]], path: str = MODEL) -> list[str]:
    return codec(path).decode_batch(ids, skip_special_tokens=False)


def check_parity(texts: list[str], path: str = MODEL) -> list[int]:
    """Positions of the texts whose ids or decoded text differ from the sentencepiece library's."""
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [x.tolist() for x, _ in word_encoder(path)(texts)]
    theirs = reference.encode(texts, num_threads=1)
    back = decode(own, path)
    return [i for i, t in enumerate(texts) if own[i] != theirs[i] or back[i] != reference.decode(theirs[i])]


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows of about `most` bytes of text, at least one row each."""
    column = batch.column(batch.schema.get_field_index("text"))
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield start, batch.num_rows


def encode(docs, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), threads: int = 2, verify_every: int = 1):
    """keep + n_tokens int, ids array<int>, round_trip boolean, parity boolean.

    round_trip: the ids decode to the text as the model normalises it (for a model that changes nothing, to the text).
    parity: the reference library gives the same ids; computed for every text, or, where `verify_every` is more than 1, for
    one text in so many by hash of the text and null for the others (0: for none). Kept columns of these names are replaced.
    """
    from pyspark.sql import functions as F

    keep = tuple(c for c in keep if c.lower() not in ("n_tokens", "ids", "round_trip", "parity"))
    kept = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, "text"))])
    fields_ = [f for f in kept.schema.fields if f.name != "text" or "text" in keep]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields_], "n_tokens int", "ids array<int>", "round_trip boolean", "parity boolean"])

    def run(it):
        import zlib

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        tokenizer, encoded, stands_for = codec(model), word_encoder(model), piece_bytes(model).__getitem__
        reference = None
        if verify_every:
            import sentencepiece

            reference = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [f.name for f in fields_]
        for batch in it:
            for start, end in _pieces(batch, BATCH_BYTES):
                part = batch.slice(start, end - start)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                live = [t for t in texts if t is not None]
                ids_of, same = iter(encoded(live)), []
                rows, trips = [], []
                for t in texts:
                    if t is None:
                        rows.append(None)
                        trips.append(None)
                        same.append(None)
                        continue
                    own, decodes = next(ids_of)
                    rows.append(own)
                    if not decodes:
                        got = b"".join(map(stands_for, own.tolist()))
                        got = got[1:] if got[:1] == b" " else got
                        decodes = got == t.encode() or got == normal(tokenizer, t).encode()
                    trips.append(decodes)
                    chosen = reference is not None and (verify_every == 1 or zlib.crc32(t.encode()) % verify_every == 0)
                    same.append(np.array_equal(reference.encode_as_numpy(t), own) if chosen else None)
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                sizes = np.array([0 if r is None else len(r) for r in rows], np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *[r for r in rows if r is not None]])), mask=pa.array([r is None for r in rows]))
                columns += [pa.array(sizes), ids, pa.array(trips, pa.bool_()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_tokens", "ids", "round_trip", "parity"])

    return kept.mapInArrow(tidy(run), out)


def normal(tokenizer, text: str) -> str:
    """The text as the model normalises it, without marker and dummy prefix."""
    got = tokenizer.normalizer.normalize_str(text).replace(MARK, " ")
    return got[1:] if got.startswith(" ") else got


def op7_sentencepiece(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
