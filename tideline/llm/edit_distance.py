"""Whether strings lie within an edit distance, by bit-parallel columns (Myers, Hyyrö): many pairs at once in numpy, or one
pair in Python's long integers. Both count the same edits of code points; which one works is a matter of speed only."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE, _TOP = U(1), U(63)


def stripped(a: str, b: str) -> tuple[str, str]:
    """Without the common start and end, which cost nothing."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[-mid:] == b[-mid:] else (lo, mid - 1)
    return (a[:-lo], b[:-lo]) if lo else (a, b)


def within(a: str, b: str, most: int) -> bool:
    """One pair; a and b are not empty."""
    where: dict[str, bytearray] = {}
    for i, x in enumerate(a):
        where.setdefault(x, bytearray((len(a) + 7) // 8))[i >> 3] |= 1 << (i & 7)
    peq = {x: int.from_bytes(v, "little") for x, v in where.items()}
    mask, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = mask, 0, len(a)
    for left, x in zip(range(len(b) - 1, -1, -1), b):
        eq = peq.get(x, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (mask ^ ((xh | pv) & mask))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score - left > most:
            return False
        ph = ((ph << 1) | 1) & mask
        xv = eq | mv
        pv = ((mh << 1) & mask) | (mask ^ ((xv | ph) & mask))
        mv = ph & xv
    return score <= most


def within_narrow(a: str, b: str, most: int, words: int) -> int:
    """One pair as within_band() takes it."""
    half = 32 * words
    where: dict[str, bytearray] = {}
    for i, x in enumerate(a, half):
        where.setdefault(x, bytearray((len(a) + half + 7) // 8))[i >> 3] |= 1 << (i & 7)
    peq = {x: int.from_bytes(v, "little") for x, v in where.items()}
    mask, top = (1 << 2 * half) - 1, 1 << (2 * half - 1)
    pv, mv, score, turn = mask ^ ((1 << half) - 1), 0, half - 1, len(a) - (half - 1)
    cap = min(most, half - 1) + len(b) - turn
    for j, x in enumerate(b):
        eq = (peq.get(x, 0) >> j) & mask
        d = ((((eq & pv) + pv) ^ pv) | eq | mv) & mask
        ph = mv | (mask ^ (d | pv))
        mh = d & pv
        if j < turn:
            score += not d & top
        else:
            high = top >> (j - turn + 1)
            score += bool(ph & high) - bool(mh & high)
        if score > cap:
            break
        d >>= 1
        pv = mh | (mask ^ (d | ph))
        mv = d & ph
    return 1 if score <= min(most, half - 1) else 0 if most < half else -1


def _codes(strings: list[str], width: int) -> np.ndarray:
    """(strings, width) code points, 0 beyond the end (no string holds it)."""
    flat = np.frombuffer("".join(x.ljust(width, "\0") for x in strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(strings), width)


def _numbered(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Code points as numbers 0..n-1 in as few bytes as hold them, and n; 0 stays 0."""
    seen = np.zeros(max(int(one.max()), int(two.max())) + 1, bool)
    seen[0] = seen[one] = seen[two] = True
    n = int(seen.sum())
    number = (np.cumsum(seen) - 1).astype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)
    return number[one], number[two], n


def within_many(a: list[str], b: list[str], most: np.ndarray, blocks: int) -> np.ndarray:
    """Pairs whose a has `blocks` blocks of 64 characters; none is empty."""
    g = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    pattern, place, letters = _numbered(_codes(a, 64 * blocks), _codes(b, int(lb.max())))
    peq = np.zeros((g, letters, blocks), U)
    row = np.repeat(np.arange(g), 64 * blocks)
    at = np.tile(np.arange(64 * blocks), g)
    np.bitwise_or.at(peq, (row, pattern.reshape(-1), at >> 6), _ONE << (at & 63).astype(U))
    peq[:, 0] = 0
    alive = np.arange(g)
    pv, mv = np.full((blocks, g), ~U(0)), np.zeros((blocks, g), U)
    score, last = la.copy(), ((la - 1) & 63).astype(U)
    out = np.zeros(g, bool)
    for j in range(place.shape[1]):
        if j and j % 32 == 0:  # what is over, or can't come down any more, goes
            done = lb[alive] <= j
            out[alive[done]] = score[done] <= most[alive[done]]
            on = np.flatnonzero(~done & (score - (lb[alive] - j) <= most[alive]))
            if not len(on):
                return out
            if len(on) < len(alive):
                alive, pv, mv, score, last = alive[on], pv[:, on], mv[:, on], score[on], last[on]
        eqs = peq[alive, place[alive, j]]
        plus, minus = _ONE, U(0)
        for k in range(blocks):
            eq, p, m = eqs[:, k], pv[k], mv[k]
            xv = eq | m
            eq = eq | minus
            xh = (((eq & p) + p) ^ p) | eq
            ph = m | ~(xh | p)
            mh = p & xh
            if k + 1 == blocks:
                score += ((((ph >> last) & _ONE).astype(np.int64) - ((mh >> last) & _ONE).astype(np.int64)) * (j < lb[alive]))
            up, down = ph >> _TOP, mh >> _TOP
            ph = (ph << _ONE) | plus
            mh = (mh << _ONE) | minus
            pv[k] = mh | ~(xv | ph)
            mv[k] = ph & xv
            plus, minus = up, down
    out[alive] = score <= most[alive]
    return out


def within_band(a: list[str], b: list[str], most: np.ndarray, words: int, step: int = 32) -> np.ndarray:
    """Pairs by a band of `words` words along the diagonal: 1 within, 0 not, -1 not within what the band holds, 32 * words - 1.
    Every a is longer than that, and lengths differ by that at most."""
    g, half = len(a), 32 * words
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    pattern, text, _ = _numbered(_codes(a, int(la.max())), _codes(b, int(lb.max())))
    wide = -(-text.shape[1] // step) * step
    # Column j sees the characters j - half .. j + half - 1 of the pattern.
    room = np.zeros((g, max(wide + 2 * half, half + pattern.shape[1])), pattern.dtype)
    room[:, half : half + pattern.shape[1]] = pattern
    seen = np.lib.stride_tricks.sliding_window_view(room, 2 * half, axis=1)
    text = np.pad(text, ((0, 0), (0, wide - text.shape[1])))
    alive, out = np.arange(g), np.full(g, half)
    pv, mv = np.zeros((words, g), U), np.zeros((words, g), U)
    pv[(words + 1) // 2 :] = ~U(0)
    if words % 2:
        pv[words // 2] = ~U(0) << U(32)
    # The score goes down the lowest diagonal until the pattern's last row, and along that row from there.
    score, turn, cap = np.full(g, half - 1), la - (half - 1), np.minimum(most, half - 1) + lb - la + half - 1
    for start in range(0, wide, step):
        same = seen[alive, start : start + step] == text[alive, start : start + step, None]
        eqs = np.ascontiguousarray(np.packbits(same, axis=2, bitorder="little").view(U).transpose(1, 2, 0))
        straight = start + step <= turn.min()
        for j in range(start, start + step):
            eq = eqs[j - start]
            total = (eq & pv) + pv
            if words > 1:
                over = total < pv
                for k in range(1, words):
                    total[k] += over[k - 1]
                    over[k] |= over[k - 1] & (total[k] == 0)
            d = (total ^ pv) | eq | mv
            ph = mv | ~(d | pv)
            mh = d & pv
            if straight:
                score += (~d[-1] >> _TOP).astype(np.int64)
            else:
                at = np.clip(2 * half - 2 - (j - turn), 0, 2 * half - 1)
                own, bit = (at >> 6, np.arange(len(alive))), (at & 63).astype(U)
                along = ((ph[own] >> bit) & _ONE).astype(np.int64) - ((mh[own] >> bit) & _ONE).astype(np.int64)
                score += np.where(j < turn, (~d[-1] >> _TOP).astype(np.int64), along) * (j < lb[alive])
            down = d >> _ONE
            if words > 1:
                down[:-1] |= d[1:] << _TOP
            pv = mh | ~(down | ph)
            mv = down & ph
        done = lb[alive] <= start + step
        out[alive[done]] = score[done]
        on = np.flatnonzero(~done & (score <= cap))
        if not len(on):
            break
        if len(on) < len(alive):
            alive, pv, mv, score, turn, cap = alive[on], pv[:, on], mv[:, on], score[on], turn[on], cap[on]
    return np.where(out <= np.minimum(most, half - 1), 1, np.where(most < half, 0, -1))


def similar(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """For each pair whether 1 - distance / longer length is at least the threshold."""
    out = np.zeros(len(a), bool)
    bins: dict[int, list[int]] = {}
    bands: dict[int, list[int]] = {}
    cut: list[tuple[str, str]] = []
    most = np.zeros(len(a), np.int64)

    def place(i, before):
        """Narrow bands first: most pairs that are within are so by far. The last one holds `most`; its width is rounded up, so that many pairs share it."""
        x, y = cut[i]
        blocks, words = (len(x) + 63) // 64, int(most[i]) // 32 + 1
        least = next((w for w in (1, 4, 16) if before < w < words and len(y) - len(x) < 32 * w), words)
        round_ = 1 << max(0, least.bit_length() - 2)
        words = -(-least // round_) * round_
        if 32 * words <= len(x) and words < blocks:
            bands.setdefault(words, []).append(i)
        else:
            bins.setdefault(blocks, []).append(i)

    def batches(own, size):
        own.sort(key=lambda i: len(cut[i][1]))
        for lo in range(0, len(own), size):
            part = own[lo : lo + size]
            yield part, [cut[i][0] for i in part], [cut[i][1] for i in part]

    for i, (x, y) in enumerate(zip(a, b)):
        most[i] = int((1 - threshold) * max(len(x), len(y)) + 1e-9)
        if abs(len(x) - len(y)) > most[i]:
            cut.append(("", ""))
            continue
        x, y = stripped(x, y)
        cut.append((x, y) if len(x) <= len(y) else (y, x))
        if not x or not y or max(len(x), len(y)) <= most[i]:
            out[i] = max(len(x), len(y)) <= most[i]
        else:
            place(i, 0)
    # Nanoseconds a column, roughly: calls and elements, against long integers.
    while bands:
        words = min(bands)
        for part, x, y in batches(bands.pop(words), max(64, 2048 // words)):
            if 24000 + words * (4000 + 15 * len(part)) < len(part) * (900 + 30 * words):
                got = within_band(x, y, most[part], words)
            else:
                got = np.array([within_narrow(*xy, int(n), words) for *xy, n in zip(x, y, most[part])])
            out[part] = got == 1
            for k in np.flatnonzero(got < 0):
                place(part[k], words)
    for blocks, own in bins.items():
        for part, x, y in batches(own, max(1, (1 << 20) // blocks // 64)):
            if blocks * (16000 + 10 * len(part)) < len(part) * (700 + 70 * blocks):
                out[part] = within_many(x, y, most[part], blocks)
            else:
                out[part] = [within(*xy, int(n)) for *xy, n in zip(x, y, most[part])]
    return out
