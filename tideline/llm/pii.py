r"""Personal data: base patterns, and further spans proposed widely and selected by boosted trees, in SQL expressions only.

Base kinds (email, ip, card, phone) are exact patterns with checks; their spans always stay. Generators propose more:
long keys (secret), addresses in words (email_text), national phone numbers (phone_local), identity numbers (id_number)
and account numbers (iban). Each proposal has features of its format (length, shares of digits and capitals, distinct
characters, groups) and of its context (words before it, quotes and equal signs next to it). Gradient-boosted trees
(Spark ML), trained on examples made by SQL from templates, score them; a threshold for each generator, calibrated on
examples kept apart to a precision of PRECISION, selects. Proposals that overlap a base span are left out.

The trees are rewritten as one SQL expression, so that a document is judged within its row: no shuffle and no join.

Positions come from splitting at the matches: the parts between them and the matches in turn give running lengths. The
patterns are written so that no start is tried twice and no group repeats by recursion; they find what the plain forms
in the comments find.

Defined cases: null text counts as empty and has no spans; redact() leaves null as it is. Offsets are code points, end
exclusive. Rows that repeat get the same spans; an empty table gives an empty table; extra columns pass through
find_spans, where input columns named like an added one are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

PRECISION = 0.95
EXAMPLES = 6000
TREES, DEPTH = 12, 3
CONTEXT = 24

BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), each part at most 255
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"t RLIKE '[0-9]\\.[0-9]'", r"forall(split(m, '\\.'), p -> transform(array(ltrim('0', p)), z -> length(z) < 3 OR (length(z) = 3 AND z <= '255'))[0])"),
    # [0-9]([\x20-]?[0-9])+, 16 to 19 digits that pass Luhn's check
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "t RLIKE '[0-9][0-9 -]{14}'", "transform(array(regexp_replace(m, '[ -]', '')), d -> length(d) BETWEEN 16 AND 19 AND aggregate(sequence(1, length(d)), 0, (a, i) -> a + transform(array(CAST(substr(d, length(d) - i + 1, 1) AS INT) * (2 - i % 2)), x -> x - if(x > 9, 9, 0))[0]) % 10 = 0)[0]"),
    # \+[0-9][\x20().0-9-]+[0-9], 8 to 15 digits
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')", "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 8 AND 15"),
}

#: Patterns that propose, with what a text must hold for the pattern to be tried.
GENERATORS = {
    "secret": (r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}", "digits"),
    "email_text": (r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64} ?[(\[] ?at ?[)\]] ?[a-z0-9-]{1,63}(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[a-z0-9-]{1,63}){1,4}", "t RLIKE '(?i)[(\\\\[] ?at ?[)\\\\]]'"),
    "phone_local": (r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "digits"),
    "id_number": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digits"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "digits"),
}
KINDS = [*BASE, *GENERATORS]

FEATURES = {
    **{f"is_{g}": f"CAST(kind = '{g}' AS DOUBLE)" for g in GENERATORS},
    "size": "CAST(length(m) AS DOUBLE)",
    "digits": "length(regexp_replace(m, '[^0-9]', '')) / CAST(length(m) AS DOUBLE)",
    "capitals": "length(regexp_replace(m, '[^A-Z]', '')) / CAST(length(m) AS DOUBLE)",
    "small": "length(regexp_replace(m, '[^a-z]', '')) / CAST(length(m) AS DOUBLE)",
    "hex_only": "CAST(m RLIKE '^[0-9a-f]+$' AS DOUBLE)",
    "distinct": "size(array_distinct(split(m, ''))) / CAST(length(m) AS DOUBLE)",
    "changes": "size(regexp_extract_all(m, '[0-9]+|[a-z]+|[A-Z]+', 0)) / CAST(length(m) AS DOUBLE)",
    "brackets": "CAST(contains(m, '(') AS DOUBLE)",
    "key_prefix": "CAST(m RLIKE '^(AKIA|ASIA|ghp_|gho_|sk-|sk_|xox|AIza|eyJ)' AS DOUBLE)",
    "says_secret": "CAST(b RLIKE '(?i)(key|token|secret|passw|pwd|bearer|auth|credential)' AS DOUBLE)",
    "says_phone": "CAST(b RLIKE '(?i)(phone|tel|call|fax|mobile|contact|whatsapp)' AS DOUBLE)",
    "says_id": "CAST(b RLIKE '(?i)(ssn|social|security|tax|identity)' AS DOUBLE)",
    "says_account": "CAST(b RLIKE '(?i)(iban|account|bank|konto|transfer)' AS DOUBLE)",
    "says_mail": "CAST(b RLIKE '(?i)(mail|write|reach|contact)' AS DOUBLE)",
    "says_other": "CAST(b RLIKE '(?i)(commit|md5|sha1|sha256|etag|build|order|isbn|part|lot|serial|flight|model|version|page|look|meet)' AS DOUBLE)",
    "assigned": "CAST(b RLIKE '[=:] ?[\\\\x22\\\\x27]?$' AS DOUBLE)",
    "quoted": "CAST(b RLIKE '[\\\\x22\\\\x27]$' AS DOUBLE)",
}

_NONE = "CAST(array() AS array<struct<kind: string, s: int, e: int, m: string, b: string>>)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(x: str) -> str:
    """SQL: of an array of numbers the sums of all before each. In blocks of 256, so that many matches don't cost their square."""
    one = "aggregate({}, named_struct('t', 0, 'a', CAST(array() AS array<int>)), (z, v) -> named_struct('t', z.t + v, 'a', concat(z.a, array(z.t))))"
    blocks = f"transform(sequence(0, CAST((size({x}) - 1) DIV 256 AS INT)), k -> slice({x}, k * 256 + 1, 256))"
    return f"transform(array(transform({blocks}, y -> {one.format('y')})), i -> transform(array({one.format('transform(i, u -> u.t)')}.a), o -> flatten(transform(i, (u, k) -> transform(u.a, v -> v + o[k])))))[0][0]"


def _matches(pattern: str, kind: str, guard: str, check: str) -> str:
    """SQL: array of (kind, s, e, m, b) of the pattern's matches in t; b is the text before within the part between matches."""
    p = _quoted(pattern)
    lengths = "transform(ms, (m, i) -> length(ps[i]) + length(m))"
    spans = f"transform(array({_running(lengths)}), r -> transform(ms, (m, i) -> named_struct('kind', '{kind}', 's', r[i] + length(ps[i]), 'e', r[i] + length(ps[i]) + length(m), 'm', m, 'b', right(ps[i], {CONTEXT}))))[0]"
    found = f"transform(array(regexp_extract_all(t, {p}, 0)), ms -> CASE WHEN size(ms) = 0 THEN {_NONE} ELSE transform(array(split(t, {p}, -1)), ps -> {spans})[0] END)[0]"
    kept = found if check == "true" else f"filter({found}, x -> transform(array(x.m), m -> {check})[0])"
    return f"CASE WHEN {guard} THEN {kept} ELSE {_NONE} END"


def _examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(kind, m, b, label, kept_apart): n made-up proposals with their contexts, all from the hash of a number."""
    rows = spark.range(n).withColumn("h", F.md5(F.concat(F.lit("pii"), F.col("id").cast("string")))).withColumn("g", F.sha1(F.col("h")))
    rows = rows.withColumn("r", F.conv(F.substring("h", 1, 6), 16, 10).cast("int")).withColumn("d", F.regexp_replace(F.translate(F.concat("g", F.sha1("g")), "abcdef", "135790"), "[^0-9]", ""))
    rows = rows.withColumn("B", F.regexp_replace(F.base64(F.unhex(F.concat("g", F.sha1("g")))), "[=+/]", ""))
    filler = ["some words of a text then ", "und es war der ", "la maison de la ", "para que el ", "it was said that "]
    good = {
        "secret": [("substr(g, 1, 18 + r % 22)", ["token = \"", "api_key: ", "secret='", "password=", "pwd: ", "Authorization: Bearer ", "access token \""]), ("concat('AKIA', upper(substr(B, 1, 16)))", filler), ("concat(element_at(array('ghp_', 'sk-', 'xox', 'AIza'), r % 4 + 1), substr(B, 1, 28 + r % 12))", filler), ("substr(B, 1, 24 + r % 16)", ["key=", "secret: ", "credential = \""])],
        "phone_local": [("concat('(', substr(d, 1, 3), ') ', substr(d, 4, 3), '-', substr(d, 7, 4))", filler + ["call ", "tel. "]), ("concat_ws('-', substr(d, 1, 3), substr(d, 4, 3), substr(d, 7, 4))", ["phone: ", "call us at ", "mobile ", "fax "])],
        "id_number": [("concat_ws('-', substr(d, 1, 3), substr(d, 4, 2), substr(d, 6, 4))", ["ssn ", "social security number ", "tax id: ", "identity "])],
        "iban": [("concat_ws(' ', concat('DE', substr(d, 1, 2)), substr(d, 3, 4), substr(d, 7, 4), substr(d, 11, 4), substr(d, 15, 4), substr(d, 19, 2))", ["iban ", "bank account ", "Konto: "] + filler), ("concat('FR', substr(d, 1, 22), '0')", ["IBAN: ", "transfer to "])],
        "email_text": [("concat(substr(regexp_replace(g, '[0-9]', 'o'), 1, 6), ' (at) ', substr(regexp_replace(h, '[0-9]', 'e'), 1, 5), ' (dot) com')", ["mail me: ", "reach me at "] + filler), ("concat('anna[at]', substr(h, 1, 6), '.org')", ["contact ", "mail "])],
    }
    bad = {
        "secret": [("substr(g, 1, 40)", ["commit ", "sha1 ", "md5 of it ", "etag ", "build "]), ("regexp_replace(substr(concat(g, h), 1, 18 + r % 20), '[0-9]', 'e')", filler), ("concat('section-', substr(d, 1, 8 + r % 6))", filler), ("substr(d, 1, 16 + r % 8)", ["order ", "serial "] + filler), ("concat('2019-', substr(d, 1, 2), '-', substr(d, 3, 2), '-part-', substr(d, 5, 3))", filler)],
        "phone_local": [("concat_ws(' ', substr(d, 1, 3), substr(d, 4, 3), substr(d, 7, 4))", ["order ", "isbn ", "part no "] + filler), ("concat_ws('.', substr(d, 1, 3), substr(d, 4, 3), substr(d, 7, 4))", ["version ", "model "])],
        "id_number": [("concat_ws('-', substr(d, 1, 3), substr(d, 4, 2), substr(d, 6, 4))", ["lot ", "part ", "model ", "page "] + filler)],
        "iban": [("concat('AB', substr(d, 1, 2), ' ', upper(substr(B, 1, 4)), ' ', upper(substr(B, 5, 4)))", ["flight ", "model ", "serial "]), ("concat('XK', substr(d, 1, 10))", ["part ", "order "] + filler)],
        "email_text": [("concat('look (at) this.', substr(regexp_replace(h, '[0-9]', 'a'), 1, 4))", ["just ", "meet ", "page "])],
    }
    cases = []
    for label, made in ((1, good), (0, bad)):
        for kind, forms in made.items():
            for form, befores in forms:
                options = "array(" + ", ".join(_quoted(x) for x in befores) + ")"
                cases.append(f"named_struct('kind', '{kind}', 'm', {form}, 'b', element_at({options}, CAST(r DIV 7 % {len(befores)} AS INT) + 1), 'label', CAST({label} AS DOUBLE))")
    # A number of no case's order picks one: CASE builds only that one.
    picked = "CASE " + " ".join(f"WHEN id % {len(cases)} = {i} THEN {c}" for i, c in enumerate(cases)) + " END"
    return rows.select(F.expr(picked).alias("x"), (F.conv(F.substring("h", 20, 4), 16, 10).cast("int") % 4 == 0).alias("kept_apart")).select("x.*", "kept_apart")


def _tree_sql(text: str, names: list[str]) -> str:
    """The nested CASE of a tree in Spark's printed form."""
    lines = [x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def build(at: int) -> tuple[str, int]:
        if lines[at].startswith("Predict"):
            return lines[at].split(":", 1)[1].strip() + "D", at + 1
        feature, bound = re.match(r"If \(feature (\d+) <= ([-0-9.Ee]+)\)", lines[at]).groups()
        left, after = build(at + 1)
        right, end = build(after + 1)
        return f"CASE WHEN f[{feature}] <= {bound}D THEN {left} ELSE {right} END", end

    return build(0)[0]


class Selector:
    """Boosted trees as SQL, and a threshold for each generator."""

    def __init__(self, score: str, thresholds: dict[str, float]):
        self.score, self.thresholds = score, thresholds

    def chosen(self, x: str) -> str:
        """SQL: whether the proposal x (kind, m, b) is selected."""
        features = "array(" + ", ".join(FEATURES.values()) + ")"
        bound = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in self.thresholds.items()) + " END"
        return f"transform(array({x}), y -> transform(array(y.kind), kind -> transform(array(y.m), m -> transform(array(y.b), b -> transform(array({features}), f -> {self.score} >= {bound})[0])[0])[0])[0])[0]"


def train(spark: SparkSession, examples: DataFrame | None = None, precision: float = PRECISION) -> Selector:
    """Boosted trees on three quarters of the examples, thresholds on the rest. The examples' number is a parameter, and nothing of the corpus is read."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(FEATURES)
    rows = (examples if examples is not None else _examples(spark)).select("kind", "label", "kept_apart", *[F.expr(e).alias(n) for n, e in FEATURES.items()]).coalesce(1)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("kind", "label", "kept_apart", "features", F.array(*names).alias("f")).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, stepSize=0.3).fit(ready.where("NOT kept_apart"))
    trees = [_tree_sql(t.toDebugString, names) for t in model.trees]
    margin = " + ".join(f"{w!r}D * ({t})" for w, t in zip(model.treeWeights, trees))
    score = f"(1 / (1 + exp(-2 * ({margin}))))"
    bins = ready.where("kept_apart").groupBy("kind", F.expr(f"CAST(floor({score} * 50) AS INT)").alias("bin")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    ready.unpersist()
    thresholds = {}
    for kind in GENERATORS:
        own = sorted(((r["bin"], r["good"], r["n"]) for r in bins if r["kind"] == kind), reverse=True)
        good = n = 0
        best = math.inf
        for b, g, m in own:
            good, n = good + g, n + m
            if good >= precision * n and good:
                best = b / 50
        thresholds[kind] = min(best, 2.0)
    return Selector(score, thresholds)


def find_spans(docs: DataFrame, selector: Selector) -> DataFrame:
    """docs with found: array of (kind, s, e) by kind as in KINDS, then start; base spans and selected proposals."""
    names = [c for c in docs.columns if c.lower() != "found"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    t, base, more, any_ = fresh([*names, "found"], "t", "base", "more", "any_")
    # `t` inside the expressions is bound by a lambda, so an input column of that name doesn't matter.
    bound = lambda sql: f"transform(array(`{t}`), t -> {sql})[0]"
    docs = docs.withColumn(t, F.coalesce(F.col("text"), F.lit(""))).withColumn(any_, F.expr(f"`{t}` RLIKE '[0-9@]|(?i)[(\\\\[] ?at ?[)\\\\]]'"))
    base_sql = "concat(" + ", ".join(bound(_matches(p, k, guard, check)) for k, (p, guard, check) in BASE.items()) + ")"
    digits = "t RLIKE '[0-9]'"
    more_sql = "concat(" + ", ".join(bound(_matches(p, k, digits if guard == "digits" else guard, "true")) for k, (p, guard) in GENERATORS.items()) + ")"
    docs = docs.withColumn(base, F.expr(f"CASE WHEN `{any_}` THEN {base_sql} ELSE {_NONE} END"))
    docs = docs.withColumn(more, F.expr(f"CASE WHEN `{any_}` THEN filter({more_sql}, x -> {selector.chosen('x')}) ELSE {_NONE} END"))
    # A selected proposal that overlaps a base span says nothing new.
    new = f"filter(`{more}`, x -> NOT exists(`{base}`, y -> y.s < x.e AND x.s < y.e))"
    found = f"transform(concat(`{base}`, {new}), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))"
    return docs.withColumn("found", F.expr(found)).select(*[F.col(f"`{c}`") for c in names], "found")


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    (new,) = fresh(docs.columns, "found_spans")
    names = docs.columns
    found = find_spans(docs.withColumn(new, F.col("text")).withColumn("text", F.col("text")), selector)
    ordered = "array_sort(transform(found, x -> struct(x.s AS s, x.e AS e, x.kind AS kind)))"
    # Left to right: where the last kept span ends, and the pieces so far.
    step = f"aggregate({ordered}, named_struct('at', 0, 'out', CAST(array() AS array<string>)), (z, x) -> named_struct('at', greatest(z.at, x.e), 'out', CASE WHEN x.s < z.at THEN z.out ELSE concat(z.out, array(substr(text, z.at + 1, x.s - z.at), concat('<', x.kind, '>'))) END))"
    text = f"CASE WHEN text IS NULL OR size(found) = 0 THEN text ELSE transform(array({step}), z -> concat(array_join(z.out, ''), substr(text, z.at + 1)))[0] END"
    return found.withColumn("text", F.expr(text)).select(*[F.col(f"`{c}`") for c in names])


def op8_pii(spark, sf_dir):
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), train(spark))
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"
    kinds = ", ".join(f"'{k}'" for k in BASE)
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(found, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2({joined.format(f'filter(found, x -> x.kind IN ({kinds}))')}, 256)").alias("base_sha256"),
        F.expr(joined.format("found")).alias("spans"),
    )
