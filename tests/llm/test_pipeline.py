"""Each stage of the pipeline against a brute-force version, on what its predecessor kept."""

from collections import Counter

import duckdb
import sentencepiece

import corpus_pipeline
from tideline.llm import quality, sentencepiece_codec

from .test_line_dedup import every_pair
from .test_mixing import brute_targets
from .test_near_dup import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    first, second, third, fourth, last = kept

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql("WITH " + quality.QUALITY_SQL.strip().format(docs="documents") + " SELECT doc_id, cleaned FROM judged WHERE kept").fetchall()
    assert sorted((r.doc_id, r.text) for r in first) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in first)

    # Of the lines that comparing all pairs removes, 0.99 at least are found, and no others go.
    gone = set(every_pair(spark, sorted(want)))
    least = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in want}
    first, want = dict(want), {r.doc_id: r.text for r in second}
    assert want.keys() == least.keys() and len(second) == len(want)
    n = lambda t: t.count("\n") + 1 if t else 0
    assert all(n(least[d]) <= n(want[d]) <= n(first[d]) for d in want)
    assert sum(n(want[d]) - n(least[d]) for d in want) <= 0.01 * len(gone)

    classes = brute_classes([r.doc_id for r in second], [r.text for r in second])
    assert sorted(r.doc_id for r in third) == sorted(set(classes.values()))
    assert all(want[r.doc_id] == r.text for r in third)

    words = Counter()
    for r in third:
        words[r.source] += len(r.text.split())
    targets, copies = brute_targets(dict(words)), Counter(r.doc_id for r in fourth)
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in third}
    for source in words:
        own = [r for r in third if r.source == source]
        e = targets[source] / words[source] if words[source] else 0
        assert abs(sum(copies[r.doc_id] for r in own) - e * len(own)) <= 1.0001

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    assert len(last) == len(fourth)
    assert all(r.ids == sp.encode(r.text) and sp.decode(r.ids) == r.text for r in last)


def test_run_gives_the_same_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = out.collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def test_odd_documents_pass_through(spark):
    line = "A perfectly ordinary sentence with more than twenty words in it, so that the rules have no reason at all to turn it down today."
    rows = [(1, None, None, None, None), (None, line, "en", "a", 5), (2, line, "en", None, 5), (2, line, "en", None, 5), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() >= 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []
