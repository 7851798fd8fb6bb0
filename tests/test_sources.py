import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tideline import changelog as cl
from tideline.changelog import EPOCH, WEIGHT
from tideline.engine import QueryEngine
from tideline.functions import scalar as fn
from tideline.functions import terms as t
from tideline.plans import algebra as A
from tideline.sources import formats, live
from tideline.sources.live import Deferred, Document, Notified, Polling, SourceSet, Status, Store, StoreEnded

Q = [("<a:a>", "<a:p>", '"1"', None), ("<a:b>", "<a:p>", '"2"', "<a:g>")]


def quads(df):
    return {(r.s, r.o): r[WEIGHT] for r in df.collect()}


def test_store_is_a_set(spark):
    store = Store(spark)
    store.add(Q)
    store.add(Q[:1])
    assert store.rounds[1].count() == 0 and store.count() == 2
    store.remove([("<a:z>", "<a:p>", '"1"', None)])
    assert store.rounds[2].count() == 0
    store.remove(Q[:1])
    store.add(Q[:1])
    assert quads(store.state) == {("<a:a>", '"1"'): 1, ("<a:b>", '"2"'): 1}
    assert store.count(p="<a:p>") == 2 and store.count(g="<a:g>") == 1 and store.count(s="<a:none>") == 0
    assert quads(store.match(upto=3)) == {("<a:b>", '"2"'): 1}


def test_events_of_one_round_in_order(spark):
    store = Store(spark)
    rows = [(*Q[0], 1, 0), (*Q[0], -1, 1), (*Q[0], 1, 2), (*Q[1], 1, 0), (*Q[1], -1, 1)]
    store.change(spark.createDataFrame(rows, f"{live.QUAD}, {WEIGHT} long, {live.SEQ} int"))
    assert quads(store.state) == {("<a:a>", '"1"'): 1}


def test_halt_resume_end_copy(spark):
    store = Store(spark)
    store.halt()
    store.add(Q)
    store.remove(Q[:1])
    assert store.count() == 0
    store.resume()
    assert store.count() == 1 and len(store.rounds) == 2
    other = store.copy()
    store.remove(Q[1:])
    assert other.count() == 1 and store.count() == 0
    store.end()
    assert store.has_ended()
    with pytest.raises(StoreEnded):
        store.add(Q)


def test_snapshot_changes(spark):
    old, new = spark.createDataFrame([(1,), (1,), (2,)], "a int"), spark.createDataFrame([(1,), (3,)], "a int")
    assert {r.a: r[WEIGHT] for r in live.snapshot_changes(old, new).collect()} == {1: -1, 2: -1, 3: 1}
    assert {r.a: r[WEIGHT] for r in live.snapshot_changes(old, new, as_set=True).collect()} == {2: -1, 3: 1}


def test_source_multiset(spark):
    q = cl.lift(spark.createDataFrame([("x", 1), ("y", 2)], "source_id string, v int"))
    ev = lambda *rows: spark.createDataFrame(rows, f"source_id string, {WEIGHT} long")
    assert {r.v: r[WEIGHT] for r in live.members(ev(("x", 1), ("x", 1), ("y", 1), ("y", -1)), q).collect()} == {1: 2}
    with pytest.raises(PySparkException, match="never added"):
        live.members(ev(("x", -1)), q).collect()


def test_source_events_and_results_as_sources(spark):
    ev = live.source_events(spark.createDataFrame([("a", True), ("b", None), ("c", False)], "source_id string, is_addition boolean"))
    assert {r.source_id: r[WEIGHT] for r in ev.collect()} == {"a": 1, "b": 1, "c": -1}
    rows = spark.createDataFrame([("<http://a/>", '"x"', 1), ("<http://b/>", "<http://c/>", -1)], f"u string, v string, {WEIGHT} long")
    assert {r.source_id: r[WEIGHT] for r in live.sources_from_results(rows).collect()} == {"http://a/": 1, "http://b/": -1, "http://c/": -1}
    assert live.sources_from_results(rows, ["u"]).count() == 2


def test_distinct_sources(spark):
    rows = [("http://a/#x", 1), ("http://a/#y", 1), ("http://a/#x", -1), ("http://b/", 1), ("http://b/", -1), ("plain", 1), ("plain", 1)]
    df = spark.createDataFrame(rows, f"source_id string, {WEIGHT} long")
    assert {r.source_id: r[WEIGHT] for r in live.distinct_sources(df).collect()} == {"http://a/": 1, "plain": 2}
    assert {r.source_id: r[WEIGHT] for r in live.distinct_sources(df, ignore_deletions=True).collect()} == {"http://a/": 1, "http://b/": 1, "plain": 2}


def test_source_set(spark):
    now = [0.0]
    s = SourceSet(spark, ["http://a/#1"], cooldown=5, clock=lambda: now[0])
    s.add("http://a/#2")
    s.remove("http://a/")
    s.remove("http://a/")
    assert s.out == [("http://a/", 1)]
    s.add("http://a/")  # back before the cooldown is over
    now[0] = 6
    s.tick()
    assert s.out == [("http://a/", 1)] and s.counts["http://a/"] == 1
    s.remove("http://a/")
    now[0] = 12
    assert [(r.source_id, r[WEIGHT]) for r in s.events().collect()] == [("http://a/", 1), ("http://a/", -1)]
    with pytest.raises(ValueError):
        s.remove("http://a/")
    lenient = SourceSet(spark, lenient=True, ignore_deletions=False)
    lenient.remove("http://never/")
    keep = SourceSet(spark, ["http://a/"], ignore_deletions=True)
    keep.remove("http://a/")
    assert keep.out == [("http://a/", 1)]
    plain = SourceSet(spark, ["x", "x"])
    plain.remove("x")
    assert plain.out == [("x", 1), ("x", 1), ("x", -1)]
    double = SourceSet(spark, ["http://a/", "http://a/"], distinct=False)
    assert double.out == [("http://a/", 1), ("http://a/", 1)]


def document(spark, versions, tags):
    return Document(lambda: versions[0] and spark.createDataFrame(versions[0], live.QUAD), lambda: tags[0])


def test_watchers(spark):
    versions, tags, now = [Q], ["v1"], [0.0]
    doc = document(spark, versions, tags)
    assert quads(doc.refresh()) == {("<a:a>", '"1"'): 1, ("<a:b>", '"2"'): 1}
    poll = Polling(doc, period=10, age=4, clock=lambda: now[0])
    assert poll.poll() is None  # nobody reads it
    doc.open()
    versions[0], tags[0] = Q[:1], "v2"
    now[0] = 5
    assert poll.poll() is None
    now[0] = 6
    assert quads(poll.poll()) == {("<a:b>", '"2"'): -1}
    now[0] = 16
    assert poll.poll() is None and doc.events == ["modified", "modified"]  # same tag: not even read
    assert Polling(doc, period=10, max_age=3).interval() == 3

    later = Deferred(doc)
    assert later.trigger_update() is None
    tags[0] = "v3"
    assert later.trigger_update().count() == 0 and doc.events[-1] == "up-to-date"
    versions[0], tags[0] = Q, "v4"
    assert quads(later.trigger_update()) == {("<a:b>", '"2"'): 1}

    told = Notified(doc)
    assert quads(told.message("Delete")) == {("<a:a>", '"1"'): -1, ("<a:b>", '"2"'): -1}
    assert quads(told.opened()) == {("<a:a>", '"1"'): 1, ("<a:b>", '"2"'): 1}
    doc.load = lambda: 1 / 0
    assert quads(told.message("Update")) == {("<a:a>", '"1"'): -1, ("<a:b>", '"2"'): -1}
    doc.close()
    assert doc.status is Status.IDLE
    assert live.choose([(poll, True), (later, False), (told, True)]) is told
    with pytest.raises(NotImplementedError):
        live.choose([(poll, False)])


def test_a_query_follows_a_document(spark):
    versions, tags = [Q[:1]], ["v1"]
    doc = document(spark, versions, tags)
    res = QueryEngine(spark).query("SELECT ?s ?o { ?s <a:p> ?o }", [doc])
    assert doc.status is Status.RUNNING and res.rows().count() == 1
    versions[0], tags[0] = [("<a:c>", "<a:p>", '"3"', None)], "v2"
    got = {(r.s, r[WEIGHT]) for r in res.push(Deferred(doc).trigger_update()).collect()}
    assert got == {("<a:a>", -1), ("<a:c>", 1)}
    res.close()
    assert doc.status is Status.IDLE


def test_polling_by_the_engine(spark, tmp_path):
    versions, tags = [Q[:1]], ["v1"]
    doc = document(spark, versions, tags)
    res = QueryEngine(spark).query("SELECT ?s ?o { ?s <a:p> ?o OPTIONAL { ?s <a:q> ?z } }", [doc], deferred=True)
    assert isinstance(res.watchers[0], Deferred) and res.poll().count() == 0
    versions[0], tags[0] = [*Q[:1], ("<a:c>", "<a:p>", '"3"', None)], "v2"
    assert {(r.s, r[WEIGHT]) for r in res.poll().collect()} == {("<a:c>", 1)}
    assert res.metadata() == {"cardinality": {"type": "exact", "value": 2}, "variables": [{"variable": "s", "canBeUndef": False}, {"variable": "o", "canBeUndef": False}]}
    assert QueryEngine(spark).query("SELECT ?s { ?s <a:p> ?o }", [doc], pollingPeriod=3).watchers[0].interval() == 3
    (tmp_path / "x.nt").write_text("<a:a> <a:p> <a:b> .\nnonsense\n")
    assert QueryEngine(spark).query("SELECT ?s { ?s <a:p> ?o }", [str(tmp_path / "x.nt")], lenient=True).rows().count() == 1


def test_blank_nodes_of_sources_never_join(spark):
    one = cl.lift(spark.createDataFrame([("_:b", "<a:p>", "<a:x>", None)], live.QUAD))
    two = cl.lift(spark.createDataFrame([("_:b", "<a:q>", "<a:y>", None)], live.QUAD))
    engine = QueryEngine(spark)
    assert engine.query("SELECT ?x { ?b <a:p> ?x ; <a:q> ?y }", [one, two]).rows().count() == 0
    assert engine.query("SELECT ?x { ?b ?p ?x }", [one, two]).rows().count() == 2
    with pytest.raises(NotImplementedError):
        engine.query("SELECT ?x { ?b ?p ?x }", [3])
    with pytest.raises(ValueError):
        engine.query("SELECT ?x { ?b ?p ?x }", [])


def test_nquads(spark, tmp_path):
    text = '# comment\n<a:a> <a:p> "x \\"y\\" z"@en .\n\n_:b <a:p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> <a:g> . # end\n<a:a> <a:p> "s"^^<http://www.w3.org/2001/XMLSchema#string> .\n<< <a:a> <a:p> <a:b> >> <a:q> <a:c> .\n'
    (tmp_path / "in.nq").write_text(text)
    got = formats.read_nquads(spark, str(tmp_path / "in.nq"))
    assert {tuple(r) for r in got.collect()} == {("<a:a>", "<a:p>", '"x \\"y\\" z"@en', None), ("_:b", "<a:p>", f'"1"^^<{t.XSD}integer>', "<a:g>"), ("<a:a>", "<a:p>", '"s"', None), ("<< <a:a> <a:p> <a:b> >>", "<a:q>", "<a:c>", None)}
    formats.write_nquads(got, str(tmp_path / "out"))
    assert {tuple(r) for r in formats.read_nquads(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in got.collect()}
    (tmp_path / "bad.nt").write_text("<a:a> nonsense .\n")
    with pytest.raises(PySparkException):
        formats.read_nquads(spark, str(tmp_path / "bad.nt")).collect()
    assert formats.read_nquads(spark, str(tmp_path / "bad.nt"), strict=False).count() == 0


def test_results_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("<a:a>", '"x"@en'), ("_:b", f'"1"^^<{t.XSD}integer>'), (None, '"q\\"\\n"')], "s string, o string")
    got = json.loads(formats.to_results_json(df))
    assert got["head"]["vars"] == ["s", "o"]
    assert {"s": {"type": "uri", "value": "a:a"}, "o": {"type": "literal", "value": "x", "xml:lang": "en"}} in got["results"]["bindings"]
    assert {"o": {"type": "literal", "value": 'q"\n'}} in got["results"]["bindings"]
    formats.write_csv(df, str(tmp_path / "csv"))
    assert {(r.s, r.o) for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).where("o <> 'q'").collect()} >= {("a:a", "x"), ("_:b", "1")}


def test_unpivot_keeps_weights(spark):
    df = cl.lift(spark.createDataFrame([(1, "a", 2.5, True)], "k int, s string, d double, b boolean"), -1)
    got = {r.o: r[WEIGHT] for r in formats.unpivot(df, "t", "k").collect()}
    assert got == {f'"1"^^<{t.XSD}integer>': -1, '"a"': -1, f'"2.5"^^<{t.XSD}double>': -1, f'"true"^^<{t.XSD}boolean>': -1}


def test_casts_give_null_for_errors(spark):
    df = spark.createDataFrame([("1",), ("x",), ("1.5",), (" 7 ",), ("99999999999999999999",)], "v string")
    got = [r.i for r in df.select(fn.cast(F.col("v"), "integer").alias("i")).collect()]
    assert got == [1, None, 1, 7, None]
    with pytest.raises(ValueError):
        fn.cast(F.col("v"), "nonsense")


def test_effective_boolean_values(spark):
    row = spark.range(1).select(fn.ebv(F.lit(""), __import__("pyspark.sql.types", fromlist=["x"]).StringType()).alias("a"), fn.ebv(F.lit(float("nan")), __import__("pyspark.sql.types", fromlist=["x"]).DoubleType()).alias("b")).first()
    assert not row.a and not row.b


def test_streams_recover_and_follow(spark, tmp_path):
    from tideline.operators.group import Agg
    from tideline.streaming.micro import StreamView

    plan = A.Group(A.Scan("t"), ["k"], {"n": Agg("count"), "hi": Agg("max", F.col("v"))})
    schema = spark.createDataFrame([], "k string, v int").schema
    put = lambda i, rows: spark.createDataFrame(rows, f"k string, v int, {WEIGHT} long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: spark.readStream.schema(f"k string, v int, {WEIGHT} long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    put(0, [("a", 1, 1), ("b", 2, 1)])
    StreamView(spark, plan, {"t": schema}, f"{tmp_path}/view").start(read()).awaitTermination()
    put(1, [("a", 5, 1), ("b", 2, -1)])
    view = StreamView(spark, plan, {"t": schema}, f"{tmp_path}/view")  # another process, say
    view.start(read()).awaitTermination()
    assert {(r.k, r.n, r.hi): r[WEIGHT] for r in view.changes().where(F.col(EPOCH) == 1).drop(EPOCH).collect()} == {("a", 1, 1): -1, ("a", 2, 5): 1, ("b", 1, 2): -1}
    view.on_batch({"t": spark.createDataFrame([("a", 5, 1), ("b", 2, -1)], f"k string, v int, {WEIGHT} long")}, 1)  # the batch runs again
    assert {(r.k, r.n, r.hi): r[WEIGHT] for r in view.result().collect()} == {("a", 2, 5): 1}


def test_an_epoch_is_one_batch_of_many_files_and_distinct_takes_few_calls(spark, monkeypatch):
    import glob

    from tideline import queries as q
    from tideline.streaming import micro

    seen = [1, 2, 3]
    rows = [(None if i % 50 == 0 else i % 50, f"x{i % 3}\n", 0.0 if i % 2 else -0.0, w, e) for i in range(600) for w, e in [(1, 0), *([(-1, 1)] if i % 50 < 20 else []), *([(1, 2)] if i % 50 < 5 else [])]]
    log_ = spark.createDataFrame(rows, f"k int, t string, d double, {WEIGHT} long, {EPOCH} int").repartition(3).withColumn("at", F.expr("timestamp_micros(1700000000000000 + coalesce(k, 7))"))
    monkeypatch.setattr(q, "_stream", lambda *a, _f=q._stream: seen.append(_f(*a)) or seen[-1])
    names = ["k", "t", "d", "at"]
    got = q._keyed(spark, log_.select(*names, WEIGHT, EPOCH), micro.distinct_stream, names).collect()
    want = {(k, t) for k, t, *_ in rows if (k or 0) % 50 >= 20 or (k or 0) < 5}
    assert {(r.k, r.t) for r in got} == want and len(got) == len(want)
    assert all(r.d == 0 and r["at"].microsecond == (r.k or 7) for r in got)
    assert len(glob.glob(f"{seen[-1]}/in/*.parquet".removeprefix("file:"))) > 3
    assert len(glob.glob(f"{seen[-1]}/out/batch=*".removeprefix("file:"))) == 3


def test_extension_registry(spark):
    from tideline.functions.extension import Registry

    made = Registry(lambda iri: ((lambda v: v + 1), "long") if iri == "http://x/inc" else None)
    assert spark.range(3).select(made.call("http://x/inc", F.col("id")).alias("n")).agg(F.sum("n")).first()[0] == 6
    with pytest.raises(NotImplementedError):
        made.call("http://x/none", F.col("id"))
