import re

import duckdb
import pytest

from tideline.llm import quality

CLEAN = "The quick brown fox jumps over the lazy dog while other animals of the wood look on and wonder why it does so."

OTHER = "Most of these beasts have seen it happen before, yet none could ever say what drives him to such efforts at dawn."


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def judged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in quality.judge(df, "cleaned").collect()}


def test_base_measures_equal_brute_force(spark):
    texts = [None, "", " \t\n", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x y " * 30, "a b c d e f g h i a b c d e f g h j", "l1\nl1\n\n\nl1 \nl2", "é#| ß\x0b1", "one two " * 4 + CLEAN + " one two " * 4, "a\r\nb\r\na\r\n"]
    texts += [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' LIMIT 60").fetchall() if len(r[0]) < 4000]
    rows = judged(spark, texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


@pytest.mark.parametrize("line", ["Home | About | News | Contact", "ALL IN CAPITALS HERE!! AND THERE!!", "word*** other$$$ more%%% ###", "All rights reserved."])
def test_failing_lines_go_and_clean_ones_stay(spark, line):
    r = judged(spark, [f"{CLEAN}\n{line}\n\n{OTHER}"])[0]
    assert r.kept and r.n_bad_lines == 1 and r.cleaned == f"{CLEAN}\n\n{OTHER}"


def test_too_much_lost(spark):
    junk = "\n".join(["word*** other$$$ more%%% and### yet&&& some*** further$$$ words%%%"] * 1 + [f"ding*** dong{i}$$$ dang%%% bell### rope&&& tower***" for i in range(9)])
    rows = judged(spark, [f"{CLEAN}\n{junk}", CLEAN])
    assert not rows[0].base_failed and not rows[0].kept and rows[1].kept


def test_very_long_repeats_end(spark):
    rows = judged(spark, ["same eight words come again and again here " * 30_000, "w" * 3_000_000])
    assert rows[0].n_repeat_words == rows[0].n_words == 240_000
    assert rows[1].n_words == 1


def test_clean_keeps_columns_and_other_rows(spark):
    df = spark.createDataFrame([(1, CLEAN, "en", 7, "x"), (1, CLEAN, "en", 7, "x"), (None, None, None, None, "y")], "doc_id long, text string, lang string, n_chars long, n_words string")
    out = quality.clean(df)
    assert out.columns == df.columns and [r.n_chars for r in out.collect()] == [len(CLEAN)] * 2
    assert quality.clean(df.limit(0)).collect() == []
