"""Questions and text retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import questions, retrieval
from tallyframe.plans.analysis import analyse

from .common import DIRTY_SQL, as_text, clean_sql, dirty_events, sql_list, table

# A question per part, worded by its key, with the part's own values in it.
QUESTION = """CASE p_partkey % 11
 WHEN 0 THEN concat('What is the average price where size is less than ', cast(p_size AS {text}))
 WHEN 1 THEN concat('Compare ', p_type, ' and small items of ', p_brand)
 WHEN 2 THEN concat('Total price by brand for size >= ', cast(p_size AS {text}), ' and no more than 40.5')
 WHEN 3 THEN concat('How many parts have ', cast(p_size AS {text}), ' units or more, at most 45')
 WHEN 4 THEN concat('Show a chart of ', p_brand)
 WHEN 5 THEN 'Is size related to retail price?'
 WHEN 6 THEN concat('Which ', lower(p_type), ' part is between ', cast(p_size AS {text}), ' and 90?')
 WHEN 7 THEN concat('price over ', cast(p_size AS {text}), ' versus under 7')
 WHEN 8 THEN 'any missing values in the column?'
 WHEN 9 THEN concat('maximum of ', p_name, ' <= 12, > ', cast(p_size AS {text}))
 ELSE p_name END"""

PHRASE = """CASE p_partkey % 9 WHEN 0 THEN 'sleep hours' WHEN 1 THEN 'Previous semester GPA' WHEN 2 THEN 'order amount'
 WHEN 3 THEN 'retail price' WHEN 4 THEN p_type WHEN 5 THEN 'performance' WHEN 6 THEN 'size' WHEN 7 THEN '?!' ELSE 'gender' END"""
COLUMNS = ["Sleep_Hours_Per_Night", "Previous_Semester_GPA", "order_amount", "p_retailprice", "p_size", "Performance_Category", "productivity_score"]

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def asked(spark, folder):
    return table(spark, folder, "part").selectExpr("p_partkey", QUESTION.format(text="string") + " AS question")


ASKED_SQL = f"asked AS (SELECT p_partkey, {QUESTION.format(text='VARCHAR')} AS question, lower(question) AS q FROM part)"


def any_sql(words):
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


COMPARATOR_COUNT = " + ".join(f"contains(q, '{w}')::INT" for w in questions.COMPARATORS)
INTENT_SQL = f"""WITH {ASKED_SQL}, t AS (SELECT p_partkey, question, CASE WHEN {any_sql(questions.CHART_WORDS)} THEN 'chart_lookup'
 WHEN {any_sql(questions.METADATA_WORDS)} THEN 'dataset_metadata' WHEN {any_sql(questions.RELATION_WORDS)} THEN 'correlation_query'
 WHEN {any_sql(questions.COMPARE_WORDS)} OR {COMPARATOR_COUNT} >= 2 THEN 'compare_groups'
 WHEN contains(q, ' by ') OR starts_with(q, 'which ') THEN 'groupby_aggregation'
 WHEN {any_sql([*questions.AGGREGATE_WORDS, *questions.CONDITION_WORDS])} THEN 'filtered_aggregation' ELSE 'unsupported' END AS intent FROM asked)
SELECT p_partkey, question, intent, cast(CASE intent {" ".join(f"WHEN '{k}' THEN {v}" for k, v in questions.CONFIDENCE.items())} END AS DOUBLE) AS confidence FROM t"""

AGGREGATE_SQL = f"""WITH {ASKED_SQL} SELECT p_partkey, question, CASE {" ".join(
    f"WHEN contains(q, '{w}') THEN '{f}'" for w, f in questions.AGGREGATE_WORDS.items())} ELSE 'mean' END AS aggregation FROM asked"""


def predicates_sql():
    parts = []
    for pattern, operator in questions.COMPARISON_PATTERNS:
        parts.append(f"SELECT p_partkey, '{operator}' AS operator, cast(unnest(regexp_extract_all(r, '{pattern}', 1)) AS DOUBLE) AS low, cast(NULL AS DOUBLE) AS high FROM w")
    b = questions.BETWEEN_PATTERN
    parts.append(f"SELECT p_partkey, 'between' AS operator, cast(unnest(regexp_extract_all(r, '{b}', 1)) AS DOUBLE) AS low, cast(unnest(regexp_extract_all(r, '{b}', 2)) AS DOUBLE) AS high FROM w")
    return f"WITH {ASKED_SQL}, w AS (SELECT p_partkey, replace(q, 'no more than', 'at most') AS r FROM asked) SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})"


VALUES_SQL = f"""vals AS (SELECT 'p_type' AS col, 1 AS o, p_type AS v FROM part GROUP BY 3 UNION ALL SELECT 'p_brand', 2, p_brand FROM part GROUP BY 3 UNION ALL SELECT 'p_name', 3, p_name FROM part GROUP BY 3),
hit AS (SELECT p_partkey, col, o, v, strpos({NORM.format('question')}, {NORM.format('v')}) AS spot FROM asked, vals WHERE {NORM.format('v')} <> '' AND contains({NORM.format('question')}, {NORM.format('v')}))"""


def mentions(spark, folder):
    parts = table(spark, folder, "part")
    return questions.value_mentions(asked(spark, folder), "p_partkey", "question", parts, ["p_type", "p_brand", "p_name"])


def group_mentions(spark, folder):
    parts = table(spark, folder, "part")
    return questions.group_mentions(asked(spark, folder), "p_partkey", "question", parts, ["p_type", "p_brand", "p_name"])


GROUPS_SQL = f"""WITH {ASKED_SQL}, {VALUES_SQL}, g AS (SELECT p_partkey, col, o, list(v ORDER BY spot, v) AS vs FROM hit GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT p_partkey, col AS "column", vs[1] AS first, vs[2] AS second FROM g QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY o) = 1"""


# Questions about yes and no: returns, "without" and "not", both sides.
FLAG_QUESTION = """CASE event_id % 8
 WHEN 0 THEN concat('How many ', event_type, ' events were returned?') WHEN 1 THEN 'Mean value without a flag'
 WHEN 2 THEN concat('Compare value with and without Flag for ', event_type) WHEN 3 THEN 'Which were not returned, which said yes?'
 WHEN 4 THEN concat(event_type, ' versus view, not flagged') WHEN 5 THEN 'the return of each kind'
 WHEN 6 THEN concat('is ', event_type, ' not of that kind or without it') ELSE 'nothing here' END"""
FLAG_COLUMNS = ["kind", "is_returned", "flag"]


def flags(spark, folder, find):
    asked_ = table(spark, folder, "events").selectExpr("event_id", FLAG_QUESTION + " AS question")
    events = dirty_events(spark, folder).selectExpr("kind", "flag AS is_returned", "if(event_id % 2 = 0, flag, null) AS flag")
    return find(asked_, "event_id", "question", events, FLAG_COLUMNS)


FLAG_SQL = f"""WITH {DIRTY_SQL}, a AS (SELECT event_id, {NORM.format(f"({FLAG_QUESTION})")} AS q FROM events),
v AS (SELECT col, o, v, {NORM.format('v')} AS w FROM (SELECT 'kind' AS col, 1 AS o, {clean_sql('kind')} AS v FROM dirty UNION SELECT 'is_returned', 2, {clean_sql('flag')} FROM dirty
 UNION SELECT 'flag', 3, {clean_sql('flag')} FROM dirty WHERE event_id % 2 = 0) WHERE v IS NOT NULL),
c(col, o, words) AS (VALUES ('kind', 1, ['kind']), ('is_returned', 2, ['is', 'returned']), ('flag', 3, ['flag'])),
yes AS (SELECT col, list(v ORDER BY v) FILTER (WHERE w IN ('yes', 'true', '1', 'returned')) AS yes, list(v ORDER BY v) FILTER (WHERE w IN ('yes', 'true', '1')) AS plain,
 list(v ORDER BY v) FILTER (WHERE w IN ('no', 'false', '0')) AS no FROM v GROUP BY col),
h AS (SELECT event_id, col, o, v, w, strpos(q, w) AS spot FROM a JOIN v ON w <> '' AND contains(q, w)),
named AS (SELECT event_id, q, c.col, o, len(list_filter(words, lambda x: contains(q, x))) > 0 AS named, yes, plain, no FROM a CROSS JOIN c LEFT JOIN yes USING (col))"""
FLAG_VALUES_SQL = f"""{FLAG_SQL}, m AS (SELECT event_id, col, min(v) AS v FROM h WHERE length(w) >= 2 GROUP BY 1, 2),
r AS (SELECT event_id, col, CASE WHEN contains(q, 'return') AND contains(col, 'return') AND len(yes) > 0 THEN yes
 WHEN (contains(q, 'without') OR contains(q, 'not ')) AND named AND len(no) > 0 THEN no END AS vs FROM named ANTI JOIN m USING (event_id, col))
SELECT event_id, col AS "column", '==' AS operator, v AS "values" FROM m UNION ALL SELECT event_id, col, 'in', array_to_string(vs, ' | ') FROM r WHERE vs IS NOT NULL"""
FLAG_GROUPS_SQL = f"""{FLAG_SQL}, two AS (SELECT event_id, col, o, 0 AS rule, list(v ORDER BY spot, v) AS vs FROM h GROUP BY 1, 2, 3 HAVING count(*) >= 2),
r AS (SELECT event_id, col, o, rule, vs[1] AS first, vs[2] AS second FROM two UNION ALL
 SELECT event_id, col, o, 1, array_to_string(plain, ' | '), array_to_string(no, ' | ') FROM named WHERE contains(q, 'without') AND named AND len(plain) > 0 AND len(no) > 0)
SELECT event_id, col AS "column", first, second FROM r QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY o, rule) = 1"""

# Questions about customers, whose names have a long beginning in common.
CUSTOMER_QUESTION = "concat('Is ', c_name, ' in ', lower(c_mktsegment), ', or Customer#', lpad(cast(c_custkey % 40 as {text}), 9, '0'), '?')"


def wide_mentions(spark, folder):
    customers = table(spark, folder, "customer")
    asked_ = customers.selectExpr("c_custkey", CUSTOMER_QUESTION.format(text="string") + " AS question")
    return questions.value_mentions(asked_, "c_custkey", "question", customers, ["c_mktsegment", "c_name"])


WIDE_SQL = f"""WITH a AS (SELECT c_custkey, {NORM.format(CUSTOMER_QUESTION.format(text='VARCHAR'))} AS q FROM customer),
v AS (SELECT 'c_mktsegment' AS col, c_mktsegment AS v, {NORM.format('c_mktsegment')} AS w FROM customer GROUP BY 2 UNION ALL SELECT 'c_name', c_name, {NORM.format('c_name')} FROM customer GROUP BY 2)
SELECT c_custkey, col AS "column", min(v) AS value FROM a JOIN v ON contains(q, w) WHERE length(w) >= 2 GROUP BY 1, 2"""


def matched(spark, folder):
    phrases = table(spark, folder, "part").selectExpr("p_partkey", PHRASE + " AS phrase")
    return questions.column_match(phrases, "p_partkey", "phrase", COLUMNS)


def match_sql():
    alias = ", ".join(f"('{k}', '{v}')" for k, vs in questions.ALIASES.items() for v in vs)
    columns = ", ".join(f"('{c}')" for c in COLUMNS)
    return f"""WITH ph AS (SELECT p_partkey, {PHRASE} AS phrase FROM part), pd AS (SELECT DISTINCT phrase, {NORM.format('phrase')} AS t FROM ph),
al AS (SELECT k, v, {NORM.format('v')} AS nv FROM (VALUES {alias}) a(k, v)),
co AS (SELECT name, {NORM.format('name')} AS cn, string_split({NORM.format('name')}, ' ') AS ct FROM (VALUES {columns}) c(name)),
ac AS (SELECT phrase, k, v, nv FROM pd JOIN al ON contains(t, k)),
ex AS (SELECT phrase, w FROM (SELECT phrase, unnest(string_split(t, ' ')) AS w FROM pd UNION ALL SELECT phrase, unnest(string_split(v, ' ')) FROM ac
  UNION ALL SELECT phrase, unnest(string_split(nv, ' ')) FROM ac) WHERE w <> '' GROUP BY 1, 2),
tok AS (SELECT phrase, name, 3 * count(*) FILTER (WHERE list_contains(ct, w)) + count(*) FILTER (WHERE contains(cn, w)) AS s FROM ex, co GROUP BY 1, 2),
ali AS (SELECT phrase, name, 10 * count(DISTINCT k) AS s FROM ac, co WHERE nv = cn OR list_has_all(ct, string_split(nv, ' ')) GROUP BY 1, 2),
sc AS (SELECT pd.phrase, t, co.name, CASE WHEN t = '' THEN 0 ELSE coalesce(tok.s, 0) + coalesce(ali.s, 0) + CASE WHEN contains(cn, t) OR contains(t, cn) THEN 6 ELSE 0 END END AS s
  FROM pd CROSS JOIN co LEFT JOIN tok ON tok.phrase = pd.phrase AND tok.name = co.name LEFT JOIN ali ON ali.phrase = pd.phrase AND ali.name = co.name),
be AS (SELECT phrase, t, max(s) AS best FROM sc GROUP BY 1, 2),
wi AS (SELECT be.phrase, be.t, best, count(*) AS n, min(name) AS name FROM be JOIN sc ON sc.phrase = be.phrase AND sc.s = be.best GROUP BY 1, 2, 3)
SELECT p_partkey, ph.phrase, CASE WHEN best > 0 AND n = 1 AND NOT (t IN ({sql_list(questions.ALIASES)}) AND best < 10) THEN name END AS matched,
 cast(best AS INTEGER) AS score FROM ph JOIN wi ON ph.phrase = wi.phrase"""


def retrieved(spark, folder):
    """Benchmark passages as queries over whole documents."""
    return retrieval.retrieve(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), "doc_id", "text", "item_id", "text"
    )


RETRIEVED_SQL = """WITH qt AS (SELECT query, term, count(*) AS c FROM
  (SELECT item_id AS query, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM benchmark) WHERE length(term) >= 3 GROUP BY 1, 2),
terms AS (SELECT DISTINCT term FROM qt), d AS (SELECT doc_id, lower(text) AS body FROM documents),
tc AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(body, '\\s+')) AS term FROM d) WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2),
h AS (SELECT s.doc_id, s.term, 1 + coalesce(n, 0) AS w FROM (SELECT doc_id, term FROM d JOIN terms ON contains(body, term)) s
  LEFT JOIN tc ON tc.doc_id = s.doc_id AND tc.term = s.term),
s AS (SELECT query, doc_id AS chunk, cast(sum(c * w) AS BIGINT) AS score FROM qt JOIN h USING (term) GROUP BY 1, 2)
SELECT query, chunk, score, cast(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""


def corpus(spark, folder):
    return analyse(table(spark, folder, "customer")).corpus()


CASES = {
    "intent_tags": (lambda spark, folder: questions.intent_tags(asked(spark, folder), "question"), INTENT_SQL),
    "aggregate_words": (lambda spark, folder: questions.aggregate_word(asked(spark, folder), "question"), AGGREGATE_SQL),
    "numeric_predicates": (
        lambda spark, folder: questions.numeric_predicates(asked(spark, folder), "p_partkey", "question"), predicates_sql(),
    ),
    "value_mentions": (
        mentions,
        f"""WITH {ASKED_SQL}, {VALUES_SQL} SELECT p_partkey, col AS "column", min(v) AS value FROM hit WHERE length({NORM.format('v')}) >= 2 GROUP BY 1, 2""",
    ),
    "value_mentions_wide": (wide_mentions, WIDE_SQL),
    "value_predicates": (lambda spark, folder: as_text(flags(spark, folder, questions.value_predicates), "values"), FLAG_VALUES_SQL),
    "group_mentions": (group_mentions, GROUPS_SQL),
    "group_predicates": (lambda spark, folder: as_text(flags(spark, folder, questions.group_predicates), "first", "second"), FLAG_GROUPS_SQL),
    "column_match": (matched, match_sql()),
    "term_retrieval": (retrieved, RETRIEVED_SQL),
    "artifact_corpus": (corpus, None),
}
