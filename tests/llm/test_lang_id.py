import zlib

import duckdb
import numpy as np

from tideline.llm import lang_id


def test_held_out_accuracy(spark):
    rows = lang_id.op5_lang_id(spark, "/root/testdata/sf0.01").collect()
    want = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert len(rows) == len(want)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in want if zlib.crc32(str(d).encode()) % 5 == 0}
    right = sum(r.lang_pred == want[r.doc_id] for r in held) / len(held)
    print("held-out accuracy", right)
    assert right >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_and_sources_never_teach(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    df = spark.createDataFrame([(i, "Das ist ein Text mit Wörtern.", "de") for i in ids], "doc_id long, text string, lang string")
    assert lang_id.training_pieces(df) == []
    assert {(r.lang_pred, r.score) for r in lang_id.predict(df, None).collect()} == {("und", 0.0)}


def net():
    rng = np.random.default_rng(1)
    one = [("aa", " ".join("".join(rng.choice(list("abcde"), 5)) for _ in range(int(rng.integers(1, 40))))) for _ in range(150)]
    two = [("bb", " ".join("".join(rng.choice(list("vwxyzü"), 5)) for _ in range(int(rng.integers(1, 40))))) for _ in range(150)]
    return lang_id.fit(one + two)


def test_tables_equal_the_network():
    n = net()
    rng = np.random.default_rng(4)
    x = lang_id.symbols(rng.integers(0, 256, (50, lang_id.WINDOW), dtype=np.uint8))
    lengths = rng.integers(1, lang_id.WINDOW + 1, 50)
    x[np.arange(lang_id.WINDOW)[None, :] >= lengths[:, None]] = 0
    assert np.allclose(np.exp(lang_id.log_probabilities(n.tables(), x, lengths)), n.forward(x, lengths)[0], atol=1e-4)


def test_gradients_equal_differences():
    n = lang_id.ByteNet(["a", "b", "c"])
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    rng = np.random.default_rng(5)
    x, lengths, y = rng.integers(0, 256, (6, lang_id.WINDOW)), rng.integers(3, 257, 6), rng.integers(0, 3, 6)
    g = n.gradients(x, lengths, y)
    loss = lambda: -np.log(n.forward(x, lengths)[0][np.arange(6), y]).mean()
    for k in n.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = n.p[k][at]
        n.p[k][at] = keep + 1e-6
        up = loss()
        n.p[k][at] = keep - 1e-6
        down = loss()
        n.p[k][at] = keep
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4, k


def test_every_byte_is_in_one_window():
    raw = np.arange(1, 251, dtype=np.uint8).repeat(4)
    offsets = np.array([0, 0, 300, 556, 1000])
    x, lengths, owner = lang_id.windows_of(raw, offsets)
    assert owner.tolist() == [1, 1, 2, 3, 3] and lengths.tolist() == [256, 44, 256, 256, 188]
    assert np.concatenate([w[:n] for w, n in zip(x, lengths)]).tolist() == raw.tolist()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !? _", "x"), (4, "abc", "x"), (4, "abc", "x"), (None, "wxy ü", "x"), (5, "abcde " * 50_000 + "w", "x"), (6, "ABCDE", "x")]
    got = lang_id.predict(spark.createDataFrame(rows, "doc_id long, text string, held_out string"), net()).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert [by[i].lang_pred for i in (4, 5, 6, None)] == ["aa", "aa", "aa", "bb"]
    assert by[None].held_out == (zlib.crc32(b"") % 5 == 0)
    assert lang_id.predict(spark.createDataFrame([], "doc_id long, text string"), None).collect() == []
