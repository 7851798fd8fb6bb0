r"""Quality rules, line first, in SQL expressions only.

Every line with a word is held against four rules: punctuation (too large a share of symbols), navigation (bars between
short items), shouting (capitals only) and boilerplate (a short line with a licence, cookie or copyright phrase). Failing
lines are removed; a document that thereby loses more than MOST_LOST of its characters is rejected, and so is one that
fails the base measures: fewer than MIN_WORDS words, or over MOST_REPEAT percent of its words in 8-word windows that
occur twice or more.

All is computed within the row: no shuffle, no join. Windows are compared by a 64-bit hash of their words' hashes within
one document.

Defined cases: null text counts as empty; a text without words has zero measures and fails the base. Lines are parts
between \n, compared byte by byte. Rows that repeat are judged alike; extra columns pass through, and input columns of a
measure's name are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

MIN_WORDS = 20
MOST_REPEAT = 30
MOST_LOST = 0.5
NOISE = 0.10
BARS = 0.2
BOILERPLATE_WORDS = 30
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "terms of service", "terms of use", "privacy policy", "cookie policy", "use cookies",
    "accept cookies", "subscribe to our", "sign up for our newsletter", "powered by", "skip to content", "skip to main", "back to top", "copyright (c)", "©",
)

_SPLIT = r"'[\\x20\\x09-\\x0D]+'"
_BLANK = r"' \t\n\u000B\f\r'"


def _words(text: str) -> str:
    """The words of a SQL string expression; the trim leaves no empty first or last part."""
    return f"transform(array(trim(BOTH {_BLANK} FROM {text})), s -> if(s = '', CAST(array() AS array<string>), split(s, {_SPLIT})))[0]"


#: Words in windows found twice: positions whose window hash has an equal neighbour in the sorted array; each covers
#: eight words, less where the next begins sooner. Names bound by lambdas are computed once.
_REPEAT = """
transform(array(transform(w, x -> xxhash64(x))), v ->
 transform(array(if(size(v) < 9, CAST(array() AS array<bigint>), transform(sequence(0, size(v) - 8), j -> xxhash64(v[j], v[j+1], v[j+2], v[j+3], v[j+4], v[j+5], v[j+6], v[j+7])))), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
   transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
    transform(array(array_sort(transform(filter(transform(s, (e, k) -> struct(e.i AS i, (k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x) AS twice)), e -> e.twice), e -> e.i))), d ->
     aggregate(transform(d, (p, k) -> if(k = size(d) - 1, 8, least(8, d[least(k + 1, size(d) - 1)] - p))), 0L, (a, n) -> a + n))[0])[0]
  END)[0])[0]
"""


def _line_fails(line: str) -> str:
    noise = f"length(regexp_replace({line}, '[^#*$%&|<>!~^={{}}]+', ''))"
    chars = f"length(regexp_replace({line}, {_SPLIT}, ''))"
    bars = f"(length({line}) - length(replace({line}, '|', '')))"
    words = f"size(split(trim(BOTH {_BLANK} FROM {line}), {_SPLIT}))"
    phrase = " OR ".join(f"contains(lower({line}), '{p}')" for p in PHRASES)
    return f"""(({noise} > {NOISE} * {chars})
 OR ({bars} >= 2 AND {bars} >= {BARS} * {words})
 OR (NOT {line} RLIKE '\\\\p{{Ll}}' AND regexp_count({line}, '\\\\p{{Lu}}') >= 10)
 OR (({phrase}) AND {words} <= {BOILERPLATE_WORDS}))"""


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "lost_share", "kept"]


def judge(docs: DataFrame, cleaned: str | None = None) -> DataFrame:
    """docs with MEASURES; with `cleaned`, also the text without failing lines, under that name."""
    names = [c for c in docs.columns if c not in MEASURES]
    q, ln, t = fresh(names + MEASURES + [cleaned or ""], "q", "ln", "t")
    has_word = r"l RLIKE '[^\\x20\\x09-\\x0D]'"
    docs = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col("text"), F.lit("")).alias(t))
    docs = docs.withColumn(q, F.expr(f"transform(array({_words(t)}), w -> named_struct('n', size(w), 'chars', length(array_join(w, '')), 'repeat', {_REPEAT}))[0]"))
    # Of each line: its text, whether it has a word, and whether it fails.
    docs = docs.withColumn(ln, F.expr(f"transform(split({t}, '\\n'), l -> transform(array({has_word}), y -> named_struct('l', l, 'word', y, 'bad', if(y, {_line_fails('l')}, false)))[0])"))
    lost = f"transform(array(filter({ln}, x -> x.word)), k -> named_struct('n', size(k), 'distinct', size(array_distinct(transform(k, x -> x.l))), 'bad', size(filter(k, x -> x.bad)), 'chars', aggregate(k, 0L, (a, x) -> a + length(x.l)), 'lost', aggregate(filter(k, x -> x.bad), 0L, (a, x) -> a + length(x.l))))[0]"
    lines = fresh(names + MEASURES + [cleaned or "", q, ln, t], "lines")[0]
    docs = docs.withColumn(lines, F.expr(lost))
    n = F.col(f"{q}.n").cast("long")
    repeat = F.col(f"{q}.repeat").cast("long")
    out = {
        "n_words": n,
        "word_chars": F.col(f"{q}.chars").cast("long"),
        "n_symbols": F.length(F.regexp_replace(F.col(t), r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.col(f"{lines}.n") - F.col(f"{lines}.distinct")).cast("long"),
        "n_repeat_words": repeat,
        "base_failed": (n < MIN_WORDS) | (100 * repeat > MOST_REPEAT * n),
        "n_lines": F.col(f"{lines}.n").cast("long"),
        "n_bad_lines": F.col(f"{lines}.bad").cast("long"),
        "lost_share": F.when(F.col(f"{lines}.chars") > 0, F.col(f"{lines}.lost") / F.col(f"{lines}.chars")).otherwise(F.lit(0.0)),
    }
    kept = ~out["base_failed"] & (out["lost_share"] <= MOST_LOST)
    extra = [F.expr(f"array_join(transform(filter({ln}, x -> NOT x.bad), x -> x.l), '\\n')").alias(cleaned)] if cleaned else []
    return docs.select(*[F.col(f"`{c}`") for c in names], *[v.alias(k) for k, v in out.items()], kept.alias("kept"), *extra)


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents without their failing lines; n_chars, where there is one, follows the text."""
    names = docs.columns
    new, verdict = fresh(names + MEASURES, "cleaned", "verdict")
    # The verdict goes through a generator that gives one row or none: a filter on it would be pushed below the
    # measures' projection and work them out a second time.
    plain = docs.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(names)], F.col("text"))
    found = judge(plain, new)
    once = F.explode(F.filter(F.array(F.struct(F.col("kept"), F.col(new).alias("text"))), lambda x: x["kept"])).alias(verdict)
    found = found.select(*[F.col(f"in{i}") for i in range(len(names))], once)
    cleaned = F.col(f"{verdict}.text")
    lower = {"text": cleaned, "n_chars": F.length(cleaned).cast("long")}
    return found.select(*[(lower[c] if c in lower else F.col(f"in{i}")).alias(c) for i, c in enumerate(names)])


def op6_quality(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


_PHRASE_SQL = " OR ".join(f"contains(lower(l), '{p}')" for p in PHRASES)

#: Common table expressions over a table or view {docs}; the last, judged, has doc_id, the measures, and cleaned.
QUALITY_SQL = rf"""
q_words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {{docs}}),
q_grams AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM q_words WHERE len(w) >= 8)),
q_starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM q_grams) WHERE c > 1),
q_repeat AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM q_starts GROUP BY doc_id),
q_split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM q_words),
q_sized AS (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
  length(regexp_replace(l, '[^#*$%&|<>!~^={{{{}}}}]+', '', 'g')) AS noise, length(l) - length(replace(l, '|', '')) AS bars FROM q_split),
q_lines AS (SELECT *, n > 0 AS word, n > 0 AND (noise > {NOISE}::DOUBLE * chars OR (bars >= 2 AND bars >= {BARS}::DOUBLE * n)
  OR (NOT regexp_matches(l, '\p{{{{Ll}}}}') AND len(regexp_extract_all(l, '\p{{{{Lu}}}}')) >= 10) OR (({_PHRASE_SQL}) AND n <= {BOILERPLATE_WORDS})) AS bad FROM q_sized),
q_loss AS (SELECT doc_id, count(*) FILTER (word) AS n_lines, count(*) FILTER (word AND bad) AS n_bad_lines, count(DISTINCT l) FILTER (word) AS n_distinct,
  coalesce(sum(length(l)) FILTER (word), 0) AS chars, coalesce(sum(length(l)) FILTER (word AND bad), 0) AS lost,
  coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (NOT bad), '') AS cleaned FROM q_lines GROUP BY doc_id),
q_all AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (l.n_lines - l.n_distinct)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, l.n_lines, l.n_bad_lines,
  CASE WHEN l.chars > 0 THEN l.lost::DOUBLE / l.chars::DOUBLE ELSE 0.0::DOUBLE END AS lost_share, l.cleaned
  FROM q_words w JOIN q_loss l USING (doc_id) LEFT JOIN q_repeat r USING (doc_id)),
q_base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT} * n_words AS base_failed FROM q_all),
judged AS (SELECT *, NOT base_failed AND lost_share <= {MOST_LOST}::DOUBLE AS kept FROM q_base)
"""

OP6_SQL = "WITH " + QUALITY_SQL.strip().format(docs="documents") + " SELECT * EXCLUDE (cleaned) FROM judged"
