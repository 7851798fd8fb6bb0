import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import audio


def naive_resample(x, up, down):
    taps = audio.lowpass(up, down).astype(np.float64)
    lead = (len(taps) - 1) // 2
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    out = []
    for m in range(-(-len(x) * up // down)):
        at = m * down
        out.append(sum(taps[k] * wide[at + lead - k] for k in range(len(taps)) if 0 <= at + lead - k < len(wide)))
    return np.array(out)


@pytest.mark.parametrize("up,down,n", [(1, 2, 193), (2, 3, 100), (3, 2, 64), (1, 2, 4)])
def test_polyphase_equals_direct_convolution(up, down, n):
    x = np.random.default_rng(1).normal(size=n).astype(np.float32)
    assert np.allclose(audio.Resampler(up, down).whole(x), naive_resample(x, up, down), atol=1e-4)


@pytest.mark.parametrize("n", [192, 576, 5_760, 40_128])
def test_blocks_give_what_one_pass_gives(monkeypatch, n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    whole = audio.log_mel(raw)
    monkeypatch.setattr(audio, "BLOCK", 1024)
    parts = audio.log_mel(raw)
    assert whole[0].shape == parts[0].shape
    assert np.allclose(whole[0], parts[0], atol=1e-4) and np.allclose(whole[1], parts[1], atol=1e-4)


@pytest.mark.parametrize("n", [576, 768, 960, 1152, 19_200, 40_128])
def test_the_end_of_a_payload_is_in_a_frame(n):
    quiet, loud = bytes([128]) * n, bytes([128]) * (n - 8) + bytes([255]) * 8
    assert not np.allclose(audio.log_mel(quiet)[1][-1], audio.log_mel(loud)[1][-1], atol=1)
    frames = len(audio.log_mel(quiet)[0])
    n_out = -(-n * audio.UP // audio.DOWN)
    assert (frames - 1) * audio.HOP + audio.FRAME >= n_out > (frames - 2) * audio.HOP + audio.FRAME


def test_hysteresis():
    db = np.array([-50, -5, -2, 0, -5, -7, -5, -5, -50, -1], np.float32)
    assert audio.active_spans(db, -3, -6).tolist() == [[1, 5], [9, 10]]
    assert audio.active_spans(np.full(3, -100, np.float32)).tolist() == []


def test_tensors_have_one_shape_and_cover_the_time():
    found = audio.features(b"\x10\x90" * 30_000)
    rows = audio.tensor_table([7], [found])
    assert rows.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.PATCH, audio.N_MELS))
    ends = rows["end_s"].to_pylist()
    assert rows["start_s"].to_pylist()[1:] == ends[:-1]


def test_digest_columns(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "x" * 193, "long " * 100_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, Text2 string")
    rows = {r.doc_id: r for r in audio.audio(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-16:])
        assert r.media_bytes == 44 + len(padded)
    assert rows[7].feature == rows[8].feature and rows[0].media_sha256 == rows[1].media_sha256


def test_empty_table(spark):
    assert audio.audio(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_written_tensors_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b " * 9000), (2, None)], "doc_id long, text string").coalesce(1)
    files = audio.write_features(df, str(tmp_path / "t")).collect()
    assert sum(f.documents for f in files) == 2
    rows = pa.ipc.open_file(files[0].path).read_all()
    assert rows.num_rows == files[0].tensors and set(rows["doc_id"].to_pylist()) == {1, 2}


def test_log_mel_equals_the_definition():
    """Direct convolution, a written-out Fourier sum and filters from their corner frequencies."""
    samples = bytes(np.random.default_rng(4).integers(0, 256, 1920, dtype=np.uint8))
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    taps = audio.lowpass()
    half = (len(taps) - 1) // 2
    y = np.array([sum(taps[half + k] * x[m - k] for k in range(-half, half + 1) if 0 <= m - k < len(x)) for m in range(0, len(x), audio.DOWN)])
    frames = 1 + -(-(len(y) - audio.FRAME) // audio.HOP)
    y = np.pad(y, (0, (frames - 1) * audio.HOP + audio.FRAME - len(y)))
    bins = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
    rate = audio.RATE // audio.DOWN
    corners = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), audio.N_MELS + 2) / 2595) - 1)
    want = np.zeros((frames, audio.N_MELS))
    for i in range(frames):
        power = np.abs(bins @ (y[i * audio.HOP : i * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME))) ** 2
        for m in range(audio.N_MELS):
            low, mid, high = corners[m : m + 3]
            for k, f in enumerate(np.arange(audio.FRAME // 2 + 1) * rate / audio.FRAME):
                want[i, m] += power[k] * max(0, min((f - low) / (mid - low), (high - f) / (high - mid)))
    mel, db = audio.log_mel(samples)
    assert np.allclose(mel, np.log(want + 1e-6), atol=2e-3) and len(db) == frames


def test_the_last_byte_changes_the_feature():
    for n in (192, 1920, 1984, 5000):
        one, two = "a" * n, "a" * (n - 1) + "z"
        assert audio._row(one)[-1] != audio._row(two)[-1]
