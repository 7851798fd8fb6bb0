import random

import numpy as np
import pytest

from tideline.llm import edit_distance as ed


def edited(rnd, letters, n, share):
    a = [rnd.choice(letters) for _ in range(n)]
    b = list(a)
    for _ in range(rnd.randrange(1, int(n * share) + 2)):
        at = rnd.randrange(len(b))
        b[at : at + rnd.randrange(2)] = rnd.choice(["", rnd.choice(letters)])
        b = b or ["a"]
    return "".join(a), "".join(b)


@pytest.mark.parametrize("words", [1, 2, 3, 5])
def test_band_equals_whole_columns(words):
    rnd, half = random.Random(words), 32 * words
    pairs = [sorted(edited(rnd, letters, rnd.randrange(half + 40, 4 * half + 80), share), key=len) for letters in ("ab", "abcdefg äß漢") for share in (0.02, 0.15, 0.4) for _ in range(30)]
    pairs += [tuple("".join(rnd.choice("abcdefgh") for _ in range(4 * half)) for _ in "ab") for _ in range(9)]
    pairs = [(a, b) for a, b in pairs if len(a) >= half and len(b) - len(a) < half]
    most = np.array([rnd.choice([3, half - 1, half, 3 * half]) for _ in pairs])
    want = [1 if ed.within(a, b, min(int(m), half - 1)) else 0 if m < half else -1 for (a, b), m in zip(pairs, most)]
    assert set(want) == {-1, 0, 1}
    assert ed.within_band([a for a, _ in pairs], [b for _, b in pairs], most, words).tolist() == want
    assert [ed.within_narrow(a, b, int(m), words) for (a, b), m in zip(pairs, most)] == want


def test_similar_equals_whole_columns_and_long_lines_take_bands(monkeypatch):
    rnd = random.Random(9)
    pairs = [edited(rnd, "abcdefg äß漢", rnd.choice([20, 90, 300, 1500]), share) for share in (0.03, 0.15, 0.3) for _ in range(80)]
    want = [ed.within(a, b, int(0.15 * max(len(a), len(b)) + 1e-9)) for a, b in pairs]
    assert ed.similar([a for a, _ in pairs], [b for _, b in pairs], 0.85).tolist() == want
    # One change in each of two far ends: no column needs all of the line's characters.
    monkeypatch.setattr(ed, "within", None)
    monkeypatch.setattr(ed, "within_many", None)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(4000))
    assert ed.similar([line], ["#" + line[1:-1] + "#"], 0.85).tolist() == [True]
