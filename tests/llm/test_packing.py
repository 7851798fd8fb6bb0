import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import packing


def slow_best_fit(lengths, size):
    rows, rooms = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [(room, row) for row, room in enumerate(rooms) if room >= lengths[i]]
        if fit:
            room = min(fit)[0]
            row = max(r for s, r in fit if s == room)  # any of equal room
        else:
            row = len(rows)
            rows.append([])
            rooms.append(size)
        rows[row].append(i)
        rooms[row] -= lengths[i]
    return rows, rooms


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40).flatmap(lambda s: st.tuples(st.just(s), st.lists(st.integers(1, s), max_size=60))))
def test_rows_equal_a_slow_best_fit(case):
    size, lengths = case
    got = packing.best_fit_decreasing(np.array(lengths, np.int64), size)
    want, rooms = slow_best_fit(lengths, size)
    assert sorted(i for r in got for i in r) == list(range(len(lengths)))
    assert sorted(size - sum(lengths[i] for i in r) for r in got) == sorted(rooms)


def test_an_item_too_long_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit_decreasing(np.array([5]), 4)


def test_nothing_is_lost(spark):
    rows = packing.op1_pack(spark, "/root/testdata/sf0.001").collect()
    tok = packing.encoder(packing.VOCABULARY)
    found = packing.unpack(rows)
    for doc, text in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        ids, k = [], 0
        while (doc, k) in found:
            ids += found.pop((doc, k))[0]
            k += 1
        assert ids[-1] == packing.END and tok.decode(ids[:-1]) == text
    assert not found
    used = sum(r.n_tokens for r in rows)
    assert all(0 < r.n_tokens <= packing.LENGTH and len(r.ids) == 2 * r.n_tokens and r.position_resets == r.cu_seqlens[:-1] for r in rows)
    assert used / (len(rows) * packing.LENGTH) > 0.95


def test_outcome_is_independent_of_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = ([tuple(map(str, r)) for r in packing.pack(x, length=256, shard=20_000).orderBy("shard", "row").collect()] for x in (df, df.repartition(5)))
    assert one == two and len({r[0] for r in one}) > 5


def test_odd_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (None, "a", 3), (3, "b <|endoftext|>", 3), (3, "b <|endoftext|>", 3), (4, "x" * 60_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    got = packing.unpack(packing.pack(df, length=64).collect())
    assert {d for d, _ in got} == {None, 3, 4} and len(got[3, 0]) == 2
    assert all(packing.END not in ids[:-1] for ids in got[3, 0])
    tok = packing.encoder(packing.VOCABULARY)
    pieces = [got[4, k][0] for k in range(sum(d == 4 for d, _ in got))]
    assert tok.decode(sum(pieces, [])[:-1]) == "x" * 60_000
    assert packing.pack(df.limit(0)).collect() == []


def test_files(spark, tmp_path):
    packed = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), length=128, shard=50_000)
    rows = {(r.shard, r.row): r for r in packed.collect()}
    for s in packing.write_packed(packed, str(tmp_path), length=128).collect():
        ids, pos, cu, at = (np.load(tmp_path / f"{n}-{s.shard:06d}.npy") for n in ("ids", "positions", "cu_seqlens", "cu_offsets"))
        assert ids.shape == pos.shape == (s.rows, 128)
        for i in range(s.rows):
            r = rows[s.shard, i]
            assert ids[i, : r.n_tokens].tobytes() == bytes(r.ids) and (ids[i, r.n_tokens :] == packing.END).all()
            assert cu[at[i] : at[i + 1]].tolist() == r.cu_seqlens
            assert np.flatnonzero(pos[i, : r.n_tokens] == 0).tolist() == r.position_resets


def test_long_white_space_and_repeated_rows(spark):
    tok = packing.encoder(packing.VOCABULARY)
    text = "a" + " " * 2_000_000 + "b" + "\n" * 5000 + "c"
    assert tok.decode(packing.encoded(tok, text)) == text
    assert packing.encoded(tok, "x  y\n\n z") == tok.encode_ordinary("x  y\n\n z")
    docs = spark.createDataFrame([(None, "the same few words")] * 64, "doc_id long, text string").coalesce(1)
    assert packing.tokenised(docs, 8).select("shard").distinct().count() > 4
