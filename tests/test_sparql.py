import pytest

from tideline import changelog as cl
from tideline.changelog import WEIGHT
from tideline.engine import QueryEngine
from tideline.functions import terms as t
from tideline.plans.sparql import SyntaxProblem
from tideline.sources.live import Store

X = "http://x/"
INT = f"^^<{t.XSD}integer>"


def iri(s):
    return f"<{X}{s}>"


def data():
    e = iri
    return [
        (e("alice"), e("likes"), '"tea"', None), (e("alice"), e("likes"), '"jam"', None), (e("bob"), e("likes"), '"tea"', None),
        (e("alice"), e("age"), f'"30"{INT}', None), (e("bob"), e("age"), f'"25"{INT}', None), (e("eve"), e("age"), '"old"', None),
        (e("alice"), e("knows"), e("bob"), None), (e("bob"), e("knows"), e("eve"), None), (e("self"), e("self"), e("self"), None),
        (e("alice"), e("name"), '"Alice"@en', None), (e("alice"), e("name"), '"Alix"@fr', None), (f"<< {e('alice')} {e('knows')} {e('bob')} >>", e("since"), f'"2001-02-03"^^<{t.XSD}date>', None),
        (e("g1s"), e("p"), '"in g1"', e("g1")), (e("g2s"), e("p"), '"in g2"', e("g2")),
    ]


@pytest.fixture(scope="module")
def quads(spark):
    return cl.checkpoint(spark.createDataFrame(data(), "s string, p string, o string, g string"))


def ask(spark, quads, text, **options):
    out = QueryEngine(spark).once(f"PREFIX : <{X}> PREFIX xsd: <{t.XSD}> " + text, quads, **options)
    return sorted((tuple(r) for r in out.collect()), key=repr)


CASES = [
    ("SELECT ?x { ?x :likes 'tea' }", [(iri("alice"),), (iri("bob"),)]),
    ("SELECT ?x ?a { ?x :likes 'tea' ; :age ?a FILTER(?a > 26) }", [(iri("alice"), f'"30"{INT}')]),
    ("SELECT ?x { ?x :age ?a FILTER(?a + 1 > 0) }", [(iri("alice"),), (iri("bob"),)]),
    ("SELECT ?x { ?x ?x ?x }", [(iri("self"),)]),
    ("SELECT ?x ?y { ?x :age ?a OPTIONAL { ?x :likes ?y FILTER(?y = 'jam') } }", [(iri("alice"), '"jam"'), (iri("bob"), None), (iri("eve"), None)]),
    ("SELECT ?x { ?x :age ?a MINUS { ?x :likes ?l } }", [(iri("eve"),)]),
    ("SELECT ?x { ?x :age ?a MINUS { ?z :likes ?l } }", [(iri("alice"),), (iri("bob"),), (iri("eve"),)]),
    ("SELECT ?x { ?x :age ?a FILTER EXISTS { ?x :knows ?y } FILTER NOT EXISTS { ?x :name ?n } }", [(iri("bob"),)]),
    ("SELECT ?x (COUNT(?l) AS ?n) { ?x :likes ?l } GROUP BY ?x HAVING(COUNT(?l) > 1)", [(iri("alice"), f'"2"{INT}')]),
    ("SELECT (SUM(?a) AS ?s) (AVG(?a) AS ?m) (MIN(?a) AS ?lo) (MAX(?a) AS ?hi) { VALUES ?a { 1 2 2 4 } }", [(f'"9"{INT}', f'"2.25"^^<{t.XSD}decimal>', f'"1"{INT}', f'"4"{INT}')]),
    ("SELECT (SUM(DISTINCT ?a) AS ?s) (COUNT(DISTINCT *) AS ?n) (COUNT(*) AS ?c) { VALUES ?a { 1 2 2 4 } }", [(f'"7"{INT}', f'"3"{INT}', f'"4"{INT}')]),
    ("SELECT (SUM(?a) AS ?s) (COUNT(?a) AS ?n) { ?x :age ?a }", [(None, f'"3"{INT}')]),
    ("SELECT (COUNT(*) AS ?n) (SUM(?z) AS ?s) (MAX(?z) AS ?m) (GROUP_CONCAT(?z) AS ?g) { ?x :nothing ?z }", [(f'"0"{INT}', f'"0"{INT}', None, '""')]),
    ("SELECT (GROUP_CONCAT(?l ; SEPARATOR=', ') AS ?g) (SAMPLE(?l) AS ?s) { :alice :likes ?l }", [('"jam, tea"', '"jam"')]),
    ("SELECT (GROUP_CONCAT(?n) AS ?g) { :alice :name ?n FILTER(LANG(?n) = 'en') }", [('"Alice"@en',)]),
    ("SELECT (MAX(?d) AS ?m) { VALUES ?d { '2001-01-01T00:00:00-08:00'^^xsd:dateTime '2001-01-01T05:00:00+09:00'^^xsd:dateTime } }", [(f'"2001-01-01T00:00:00-08:00"^^<{t.XSD}dateTime>',)]),
    ("SELECT DISTINCT ?l { ?x :likes ?l }", [('"jam"',), ('"tea"',)]),
    ("SELECT ?l { ?x :likes ?l }", [('"jam"',), ('"tea"',), ('"tea"',)]),
    ("SELECT ?l { { ?x :likes ?l } UNION { ?x :name ?n } }", [('"jam"',), ('"tea"',), ('"tea"',), (None,), (None,)]),
    ("SELECT ?x { ?x :age ?a } ORDER BY DESC(?a) LIMIT 1", [(iri("eve"),)]),
    ("SELECT ?x { ?x :age ?a } ORDER BY ?a OFFSET 1 LIMIT 1", [(iri("alice"),)]),
    ("SELECT ?x { ?x :age ?a } ORDER BY ?a", [(iri("alice"), 1), (iri("bob"), 0), (iri("eve"), 2)]),
    ("SELECT ?o { :alice :knows/:knows ?o }", [(iri("eve"),)]),
    ("SELECT ?s { ?s ^:knows :alice }", [(iri("bob"),)]),
    ("SELECT ?s { :alice (:knows|:likes) ?s }", [('"jam"',), ('"tea"',), (iri("bob"),)]),
    ("SELECT ?o { :alice !(:likes|:age|:name) ?o }", [(iri("bob"),)]),
    ("SELECT ?o { :alice :knows? ?o }", [(iri("alice"),), (iri("bob"),)]),
    ("SELECT ?o { :stranger :knows? ?o }", [(iri("stranger"),)]),
    ("SELECT ?d { << :alice :knows ?y >> :since ?d }", [(f'"2001-02-03"^^<{t.XSD}date>',)]),
    ("SELECT ?y (YEAR(?d) AS ?yr) { << ?x :knows ?y >> :since ?d }", [(iri("bob"), f'"2001"{INT}')]),
    ("SELECT ?g ?o { GRAPH ?g { ?s :p ?o } }", [(iri("g1"), '"in g1"'), (iri("g2"), '"in g2"')]),
    ("SELECT ?o { GRAPH :g1 { ?s :p ?o } }", [('"in g1"',)]),
    ("SELECT ?o { ?s :p ?o }", []),
    ("SELECT ?o FROM :g2 { ?s :p ?o }", [('"in g2"',)]),
    ("SELECT ?o FROM NAMED :g2 { GRAPH ?g { ?s :p ?o } }", [('"in g2"',)]),
    ("SELECT ?x ?v { VALUES (?x ?v) { (:alice UNDEF) (:bob 2) } ?x :age ?a }", [(iri("alice"), None), (iri("bob"), f'"2"{INT}')]),
    ("SELECT ?x ?l { VALUES (?x ?l) { (:alice UNDEF) (UNDEF 'tea') } ?x :likes ?l }", [(iri("alice"), '"jam"'), (iri("alice"), '"tea"'), (iri("alice"), '"tea"'), (iri("bob"), '"tea"')]),
    ("SELECT ?x { { SELECT ?x (COUNT(*) AS ?n) { ?x :likes ?l } GROUP BY ?x } FILTER(?n = 2) }", [(iri("alice"),)]),
    ("SELECT * { :bob :likes ?l }", [('"tea"',)]),
    ("SELECT ?b { BIND(1/0 AS ?a) BIND(COALESCE(?a, 'none') AS ?b) }", [('"none"',)]),
    ("SELECT ?x { [] :likes ?x ; :age 25 }", [('"tea"',)]),
]


@pytest.mark.parametrize("text,want", CASES, ids=range(len(CASES)))
def test_queries(spark, quads, text, want):
    assert ask(spark, quads, text) == sorted(want, key=repr)


EXPRESSIONS = [
    ("STRLEN('日本')", f'"2"{INT}'), ("UCASE('a'@en)", '"A"@en'), ("SUBSTR('hello', 2, 3)", '"ell"'), ("CONCAT('a', 'b')", '"ab"'), ("STRBEFORE('abc', 'b')", '"a"'), ("STRAFTER('abc', 'z')", '""'),
    ("REPLACE('abab', 'a', 'x')", '"xbxb"'), ("REGEX('ABC', '^a', 'i')", f'"true"^^<{t.XSD}boolean>'), ("ENCODE_FOR_URI('a b/ü')", '"a%20b%2F%C3%BC"'), ("STRDT('1', xsd:integer)", f'"1"{INT}'), ("STRLANG('a', 'EN')", '"a"@en'),
    ("1 + 2", f'"3"{INT}'), ("1 / 2", f'"0.5"^^<{t.XSD}decimal>'), ("4 / 2", f'"2"^^<{t.XSD}decimal>'), ("2 * 1.5", f'"3"^^<{t.XSD}decimal>'), ("1e0 + 1", f'"2.0"^^<{t.XSD}double>'), ("-3 - 1", f'"-4"{INT}'), ("ROUND(-2.5)", f'"-2"^^<{t.XSD}decimal>'),
    ("ABS(-2)", f'"2"{INT}'), ("CEIL(1.2)", f'"2"^^<{t.XSD}decimal>'), ("FLOOR(1.8)", f'"1"^^<{t.XSD}decimal>'), ("IF(1 < 2, 'y', 'n')", '"y"'), ("'a' + 1", None), ("BOUND(?zz)", f'"false"^^<{t.XSD}boolean>'),
    ("2 IN (1, 2)", f'"true"^^<{t.XSD}boolean>'), ("'a' NOT IN ('b')", f'"true"^^<{t.XSD}boolean>'), ("1 = 1.0", f'"true"^^<{t.XSD}boolean>'), ("sameTerm(1, 1.0)", f'"false"^^<{t.XSD}boolean>'), ("!('')", f'"true"^^<{t.XSD}boolean>'),
    ("DATATYPE(1)", f"<{t.XSD}integer>"), ("DATATYPE('a'@en)", f"<{t.RDF}langString>"), ("LANG('a'@en)", '"en"'), ("LANGMATCHES('en-gb', 'EN')", f'"true"^^<{t.XSD}boolean>'), ("IRI('http://y/')", "<http://y/>"), ("STR(<http://y/>)", '"http://y/"'),
    ("isIRI(<http://y/>)", f'"true"^^<{t.XSD}boolean>'), ("isNumeric('1')", f'"false"^^<{t.XSD}boolean>'), ("isLiteral(1)", f'"true"^^<{t.XSD}boolean>'), ("isTRIPLE(TRIPLE(:a, :b, 1))", f'"true"^^<{t.XSD}boolean>'), ("OBJECT(TRIPLE(:a, :b, 'x y'))", '"x y"'),
    ("MONTH('2001-02-03T04:05:06Z'^^xsd:dateTime)", f'"2"{INT}'), ("HOURS('2001-02-03T04:05:06+09:00'^^xsd:dateTime)", f'"4"{INT}'), ("TZ('2001-02-03T04:05:06+09:00'^^xsd:dateTime)", '"+09:00"'), ("TIMEZONE('2001-02-03T04:05:06-08:30'^^xsd:dateTime)", f'"-PT8H30M"^^<{t.XSD}dayTimeDuration>'),
    ("SECONDS('2001-02-03T04:05:06.5Z'^^xsd:dateTime)", f'"6.5"^^<{t.XSD}decimal>'), ("MD5('a')", '"0cc175b9c0f1b6a831c399e269772661"'), ("SHA256('')", '"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"'),
    ("xsd:integer('7')", f'"7"{INT}'), ("xsd:integer('x')", None), ("xsd:boolean('1')", f'"true"^^<{t.XSD}boolean>'), ("xsd:double('1e3')", f'"1000.0"^^<{t.XSD}double>'), ("xsd:date('2001-02-03')", f'"2001-02-03"^^<{t.XSD}date>'), ("xsd:string(5)", '"5"'), ("xsd:duration('P1D')", f'"P1D"^^<{t.XSD}duration>'),
    ("'2001-01-01T00:00:00Z'^^xsd:dateTime < '2001-01-01T00:00:00-01:00'^^xsd:dateTime", f'"true"^^<{t.XSD}boolean>'), ("'b' > 'a'", f'"true"^^<{t.XSD}boolean>'), ("'quo\\\"te\\n'", '"quo\\"te\\n"'), ("STRLEN('a\\\\n')", f'"3"{INT}'),
]


def test_expressions(spark, quads):
    selected = " ".join(f"({e} AS ?v{i})" for i, (e, _) in enumerate(EXPRESSIONS))
    (got,) = ask(spark, quads, f"SELECT {selected} {{ }}")
    assert {e: g for (e, _), g in zip(EXPRESSIONS, got)} == dict(EXPRESSIONS)


@pytest.mark.parametrize("text", ["ASK { ?s ?p ?o }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "DESCRIBE <http://x/>", "INSERT DATA { <a:a> <a:b> 1 }", "SELECT ?x { ?x :a* ?y }", "SELECT ?x { ?x :a+ ?y }", "SELECT ?x { SERVICE <http://x/> { ?x :a ?y } }", "SELECT ?x { ?x :a ?y FILTER(?y = 1 || EXISTS { ?x :b ?z }) }", "SELECT (:f(?x) AS ?y) { ?x :a ?z }"])
def test_unsupported_forms_say_so(spark, quads, text):
    with pytest.raises(NotImplementedError):
        ask(spark, quads, text)


@pytest.mark.parametrize("text", ["SELECT { ?s ?p ?o }", "SELECT ?s { ?s ?p }", "SELECT ?s WHERE ?s", "SELECT ?x { ?x nope:a ?y }", "SELECT (1 AS ?x) { ?x :a ?y }"])
def test_syntax_errors(spark, quads, text):
    with pytest.raises((SyntaxProblem, ValueError)):
        ask(spark, quads, text)


def test_options(spark, quads):
    assert len(ask(spark, quads, "SELECT ?o { ?s :p ?o }", unionDefaultGraph=True)) == 2
    assert ask(spark, quads, "SELECT ?l { ?x :likes ?l }", initialBindings={"x": iri("bob")}) == [('"tea"',)]
    assert ask(spark, quads, "SELECT ?o { :alice :knows+ ?o }", closures=True) == [(iri("bob"),), (iri("eve"),)]
    shout = {f"{X}shout": lambda v: v.str.upper()}
    assert ask(spark, quads, "SELECT (:shout(?l) AS ?u) { :bob :likes ?l }", extensionFunctions=shout) == [('"TEA"',)]
    engine = QueryEngine(spark)
    assert "Scan(name=quads)" in engine.explain("SELECT ?s { ?s ?p ?o }")
    assert "Select(" in engine.explain("SELECT ?s { ?s ?p ?o }", "parsed") and "Physical Plan" in engine.explain("SELECT ?s { ?s ?p ?o }", "physical", quads)
    with pytest.raises(TypeError):
        engine.query("SELECT ?s { ?s ?p ?o }", [quads], nonsense=1)


def test_results_follow_a_store(spark):
    store = Store(spark)
    store.add([q for q in data() if q[1] in (iri("likes"), iri("age"))])
    res = QueryEngine(spark).query(f"PREFIX : <{X}> SELECT ?x (COUNT(*) AS ?n) {{ ?x :likes ?l }} GROUP BY ?x", [store])
    as_set = lambda df: {(r.x, r.n, r[WEIGHT]) for r in df.collect()}
    assert as_set(res.changes()) == {(iri("alice"), f'"2"{INT}', 1), (iri("bob"), f'"1"{INT}', 1)}
    store.add([(iri("bob"), iri("likes"), '"jam"', None)])
    assert as_set(res.changes()) == {(iri("bob"), f'"1"{INT}', -1), (iri("bob"), f'"2"{INT}', 1)}
    store.add([(iri("bob"), iri("likes"), '"jam"', None)])  # present already
    assert as_set(res.changes()) == set()
    store.remove([(iri("bob"), iri("likes"), '"jam"', None), (iri("bob"), iri("likes"), '"tea"', None)])
    assert as_set(res.changes()) == {(iri("bob"), f'"2"{INT}', -1)}
    assert as_set(res.retract()) == {(iri("alice"), f'"2"{INT}', -1)}
    store.remove([(iri("alice"), iri("likes"), '"jam"', None)])
    assert res.rows().count() == 1  # closed: not followed any more


def test_unbound_variables_fit_anything(spark, quads):
    chain = "SELECT ?s ?v { ?s :likes 'tea' OPTIONAL { ?s :name ?v } OPTIONAL { ?s :age ?v } }"
    assert ask(spark, quads, chain) == sorted([(iri("alice"), '"Alice"@en'), (iri("alice"), '"Alix"@fr'), (iri("bob"), f'"25"{INT}')], key=repr)
    # eve's age is no number, so ?n is unbound and fits any age.
    some = "SELECT ?s { ?s :age ?a OPTIONAL { ?s :age ?n FILTER(?n > 0) } FILTER %sEXISTS { ?o :age ?n ; :likes 'jam' } }"
    assert ask(spark, quads, some % "") == [(iri("alice"),), (iri("eve"),)]
    assert ask(spark, quads, some % "NOT ") == [(iri("bob"),)]
    older = "SELECT ?s { ?s :age ?n FILTER %sEXISTS { ?o :age ?m FILTER(?m > ?n) } }"
    assert ask(spark, quads, older % "") == [(iri("bob"),)]
    assert ask(spark, quads, older % "NOT ") == [(iri("alice"),), (iri("eve"),)]


def test_stores_together_follow_changes(spark):
    one, two = Store(spark), Store(spark)
    for s in (one, two):
        s.add([("_:x", iri("p"), '"see _:y"', None), (f"<< _:x {iri('p')} _:z >>", iri("q"), "_:x", "_:g")])
    res = QueryEngine(spark).query(f"SELECT ?s ?o {{ ?s <{X}p> ?o }}", [one, two])
    rows = sorted(tuple(r) for r in res.rows().collect())
    assert len({s for s, _ in rows}) == 2 and {o for _, o in rows} == {'"see _:y"'}
    one.remove([("_:x", iri("p"), '"see _:y"', None)])
    two.add([("_:x", iri("p"), '"more"', None)])
    left = sorted(tuple(r) for r in res.rows().collect())
    assert len(left) == 2 and len({s for s, _ in left}) == 1 and set(s for s, _ in left) < {s for s, _ in rows}
    q = QueryEngine(spark).query(f"SELECT ?t ?o {{ GRAPH ?g {{ ?t <{X}q> ?o }} }}", [one, two])
    for r in q.rows().collect():
        assert r.t.startswith(f"<< {r.o} ") and r.t.count(r.o[:34]) == 2
