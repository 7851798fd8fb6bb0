"""Media columns: 8-bit PCM audio, its log-mel features and its active spans.

A payload is stored as the samples of an uncompressed WAV file (one channel, unsigned 8 bits), which keeps every byte.
Features are computed from the samples read back: polyphase resampling by UP / DOWN, overlapped frames through a mel
filterbank, logarithms, and a segmentation by frame energy with two thresholds (a span opens above the higher and
closes below the lower one). Log-mel frames are pooled into tensors of one fixed shape (PATCH frames x N_MELS), each
with its time span, kept as an Arrow fixed-shape tensor column by write_features().

All work is row-local and runs in blocks of BLOCK samples, so memory doesn't grow with the length of a text.

Defined cases: null counts as the empty text; the empty text is one unit of padding (192 bytes of 32). A silent signal
has features, and no active span. Every sample is in a frame; the last frame is filled up with zeros. Equal texts give equal values. Repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import table

UNIT = 192
PAD = b" "
RATE = 16000
UP, DOWN = 1, 2
FRAME, HOP = 256, 128
N_MELS = 16
PATCH = 64
BLOCK = 1 << 19
HIGH_DB, LOW_DB = -3.0, -6.0


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, padded, and their number before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> tuple[memoryview, int]:
    """(samples, rate); walks the chunks of the file."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(view):
        kind, n = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", view[at + 8 : at + 24])
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only PCM of one 8-bit channel is stored here")
        elif kind == b"data":
            return view[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


def lowpass(up: int = UP, down: int = DOWN, half: int = 8) -> np.ndarray:
    """Windowed-sinc prototype of the resampler, at `up` times the input rate."""
    wide = max(up, down)
    n = np.arange(-half * wide, half * wide + 1)
    taps = np.sinc(n / wide) * np.hamming(len(n)) / wide * up
    return taps.astype(np.float32)


class Resampler:
    """Polyphase resampling by up / down of a signal that comes in blocks: output m is the dot product of the phase
    (m * down) % up of the prototype with the input around m * down / up. Zeros stand beyond both ends."""

    def __init__(self, up: int = UP, down: int = DOWN):
        self.up, self.down = up, down
        taps = lowpass(up, down)
        self.lead = (len(taps) - 1) // 2
        self.width = -(-len(taps) // up)
        padded = np.zeros(self.width * up, np.float32)
        padded[: len(taps)] = taps
        self.phases = padded.reshape(self.width, up).T[:, ::-1].copy()  # phase p: taps p, p+up, ... in input order

    def whole(self, x: np.ndarray) -> np.ndarray:
        n_out = -(-len(x) * self.up // self.down)
        out = np.empty(n_out, np.float32)
        padded = np.concatenate([np.zeros(self.width, np.float32), x, np.zeros(self.width + self.lead // self.up + 1, np.float32)])
        for r in range(self.up):  # outputs m = r, r + up, ... share a phase and step evenly through the input
            m = np.arange(r, n_out, self.up)
            if not len(m):
                continue
            at = m[0] * self.down + self.lead
            start = at // self.up - self.width + 1 + self.width
            view = np.lib.stride_tricks.sliding_window_view(padded[start:], self.width)[:: self.down][: len(m)]
            out[m] = view @ self.phases[at % self.up]
        return out


def mel_bank(rate: float, frame: int = FRAME, n_mels: int = N_MELS) -> np.ndarray:
    """(bins, mels) triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    bank = np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))
    return bank.astype(np.float32)


_RESAMPLER = Resampler()
_BANK = mel_bank(RATE * UP / DOWN)
_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(samples: memoryview | bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies, frame energies in dB). Blocks overlap by what the filters reach, so that they give
    what one pass over the whole signal gives."""
    x = np.frombuffer(samples, np.uint8)
    per = HOP * DOWN // UP  # input samples a frame step
    reach = 2 * _RESAMPLER.width * max(1, DOWN)
    n_out = -(-len(x) * UP // DOWN)
    n_frames = 1 + max(0, -(-(n_out - FRAME) // HOP))  # the last one is filled up with zeros
    step = max(1, BLOCK // per)
    mels, dbs = [], []
    for first in range(0, n_frames, step):
        count = min(step, n_frames - first)
        lo = max(0, first * per - (reach // DOWN + 1) * DOWN)
        hi = min(len(x), (first + count - 1) * per + FRAME * DOWN // UP + reach)
        y = _RESAMPLER.whole((x[lo:hi].astype(np.float32) - 128) / 128)
        y = y[first * HOP - lo * UP // DOWN :]
        need = (count - 1) * HOP + FRAME
        y = np.pad(y, (0, max(0, need - len(y))))[:need]
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        for at in range(0, count, 512):
            part = frames[at : at + 512]
            dbs.append(10 * np.log10(np.mean(part * part, axis=1) + 1e-10))
            spectrum = np.fft.rfft(part * _WINDOW, axis=1)
            power = spectrum.real**2 + spectrum.imag**2
            mels.append(np.log(power.astype(np.float32) @ _BANK + 1e-6))
    return np.concatenate(mels).astype(np.float32), np.concatenate(dbs).astype(np.float32)


def active_spans(db: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> np.ndarray:
    """(n, 2) frame spans, end exclusive. Levels are relative to the signal's loudest frame. A run of frames at or above
    `low` is a span if one of its frames reaches `high`."""
    if not len(db) or float(db.max()) <= -99:
        return np.zeros((0, 2), np.int64)
    level = db - db.max()
    on = np.concatenate([[0], (level >= low).astype(np.int8), [0]])
    edge = np.diff(on)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    peaks = np.concatenate([[0], np.cumsum(level >= high)])
    keep = peaks[ends] > peaks[starts]
    return np.stack([starts[keep], ends[keep]], axis=1)


def patches(mel: np.ndarray) -> np.ndarray:
    """(n, PATCH, N_MELS): the frames in tensors of one shape, the last one filled up with its smallest value."""
    n = -(-len(mel) // PATCH)
    out = np.full((n * PATCH, mel.shape[1]), mel.min(), np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, PATCH, mel.shape[1])


def features(samples: memoryview | bytes, rate: int = RATE) -> dict:
    """Tensors, their time spans in seconds, and the active spans in seconds."""
    mel, db = log_mel(samples)
    second = HOP * DOWN / UP / rate
    tensors = patches(mel)
    spans = active_spans(db)
    starts = np.arange(len(tensors)) * PATCH * second
    ends = np.minimum((np.arange(len(tensors)) + 1) * PATCH, len(mel)) * second
    return {"tensors": tensors, "spans": np.stack([starts, ends], axis=1), "active": spans * second, "mel": mel, "db": db}


def digest(found: dict) -> str:
    """Frames, tensors with their spans, active spans and their seconds, and the mean log-mel vector to two decimals; tensors and
    spans as a hash of all their values, to the hundredth and the millisecond."""
    mean = ",".join(f"{v:.2f}" for v in found["mel"].mean(axis=0, dtype=np.float64) + 0.0)
    active = found["active"]
    sha = hashlib.sha256(np.round(found["tensors"] * 100).astype("<i4").tobytes())
    for spans in (found["spans"], active):
        sha.update(np.round(spans * 1000).astype("<i8").tobytes())
    return f"frames={len(found['mel'])};content={sha.hexdigest()[:32]};tensors={len(found['tensors'])};active={len(active)};seconds={float((active[:, 1] - active[:, 0]).sum()):.3f};mel={mean}"


def tensor_table(ids: list, found: list[dict]) -> pa.Table:
    """One row per tensor: doc_id, start and end in seconds, and the tensor as an Arrow fixed-shape tensor."""
    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, N_MELS))
    flat = np.concatenate([f["tensors"].reshape(len(f["tensors"]), -1) for f in found]) if found else np.zeros((0, PATCH * N_MELS), np.float32)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), PATCH * N_MELS)
    spans = np.concatenate([f["spans"] for f in found]) if found else np.zeros((0, 2))
    return pa.table(
        {
            "doc_id": pa.array([i for i, f in zip(ids, found) for _ in range(len(f["tensors"]))], pa.int64()),
            "start_s": pa.array(spans[:, 0]),
            "end_s": pa.array(spans[:, 1]),
            "log_mel": pa.ExtensionArray.from_storage(kind, storage),
        }
    )


def batches(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes, at least one row each."""
    rows = max(1, int(most * batch.num_rows / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def write_features(docs, path: str):
    """Write the tensors of docs (doc_id, text) as Arrow IPC files, one per non-empty partition, into a shared folder.

    Each task writes its own file under a name made of the partition and moves it into place when complete, so that a
    task that is run again replaces it. Returns one row per file: path, documents, tensors. The path must be one that
    all executors mount.
    """

    def run(it):
        import os

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sink, n_docs, n_tensors = None, 0, 0
        name = f"{path}/part-{part:05d}.arrow"
        held = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
        for batch in it:
            for piece in batches(batch):
                found = [features(from_wav(to_wav(payload_of(t)[0]))[0]) for t in piece.column("text").to_pylist()]
                rows = tensor_table(piece.column("doc_id").to_pylist(), found)
                if sink is None:
                    os.makedirs(path, exist_ok=True)
                    sink = pa.ipc.new_file(held, rows.schema)
                sink.write_table(rows)
                n_docs, n_tensors = n_docs + piece.num_rows, n_tensors + rows.num_rows
        if sink is not None:
            sink.close()
            os.replace(held, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "documents": [n_docs], "tensors": [n_tensors]})

    return docs.select("doc_id", "text").mapInArrow(run, "path string, documents long, tensors long")


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _row(text: str | None) -> tuple:
    payload, n = payload_of(text)
    media = to_wav(payload)
    back, rate = from_wav(media)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), digest(features(back, rate))


def audio(docs):
    """One row per document with the digest columns of its stored audio."""

    def run(it):
        for batch in it:
            for piece in batches(batch):
                rows = [_row(t.as_py()) for t in piece.column("text")]
                columns = list(zip(*rows))
                ids = pc.cast(piece.column("doc_id"), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:])]], schema=_OUT)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_audio(spark, sf_dir):
    return audio(table(spark, sf_dir, "documents"))
