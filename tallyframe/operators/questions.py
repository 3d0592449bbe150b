"""Tagging a table of questions: intent, aggregate, predicates, columns, values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise, normalise_name
from ..functions.values import clean_text, dtype_of, ref
from .frequency import few_values

# Aggregate words and what they ask for, in order of precedence.
AGGREGATE_WORDS = {
    "average": "mean", "avg": "mean", "mean": "mean", "median": "median",
    "total": "sum", "sum": "sum", "count": "count", "how many": "count",
    "minimum": "min", "min": "min", "maximum": "max", "max": "max",
    "std": "std", "standard deviation": "std",
}
# Words of each intent, in order of precedence.
CHART_WORDS = ("chart", "dashboard", "visual", "pattern")
METADATA_WORDS = ("column", "missing", "rows", "dataset")
RELATION_WORDS = (
    "correlation", "correlate", "related", "relationship", "relate", "affect", "higher", "lower",
)
COMPARE_WORDS = ("compare", " versus ", " vs ", "difference between", " with students who ")
COMPARATORS = (
    "less than", "under", "below", "more than", "greater than", "above", "at least", "at most",
    " or less", " or more", "<", ">",
)
CONDITION_WORDS = (
    "less than", "below", "under", "fewer than", "or less", "or fewer", "at most",
    "less than or equal to", "more than", "above", "greater than", "or more", "at least",
    "greater than or equal to", "<", ">",
)
# How sure each intent is.
CONFIDENCE = {
    "chart_lookup": 0.78, "dataset_metadata": 0.72, "correlation_query": 0.82,
    "compare_groups": 0.86, "groupby_aggregation": 0.75, "filtered_aggregation": 0.76,
    "unsupported": 0.3,
}
# Comparison phrases around a number.
NUMBER = r"(\d+(?:\.\d+)?)"
COMPARISON_PATTERNS = (
    (r"<=\s*" + NUMBER, "<="),
    (r"<\s*" + NUMBER, "<"),
    (r">=\s*" + NUMBER, ">="),
    (r">\s*" + NUMBER, ">"),
    (r"(?:less than or equal to)\s*" + NUMBER, "<="),
    (r"(?:less than|under|below|fewer than)\s*" + NUMBER, "<"),
    (NUMBER + r"\s*(?:\w+)?\s*or\s*(?:less|fewer)", "<="),
    (r"(?:at most|no more than)\s*" + NUMBER, "<="),
    (r"(?:greater than or equal to)\s*" + NUMBER, ">="),
    (r"(?:more than|greater than|above|over)\s*" + NUMBER, ">"),
    (NUMBER + r"\s*(?:\w+)?\s*or more", ">="),
    (r"(?:at least|minimum of)\s*" + NUMBER, ">="),
)
BETWEEN_PATTERN = r"between\s*" + NUMBER + r"\s*and\s*" + NUMBER
# Phrases and the column wordings they stand for.
ALIASES = {
    "previous semester gpa": ["previous semester gpa", "previous_semester_gpa", "prev semester gpa", "prior semester gpa", "gpa", "grades", "grade"],
    "semester gpa": ["previous semester gpa", "previous_semester_gpa", "semester gpa", "semester_gpa", "gpa", "grades", "grade"],
    "gpa": ["previous semester gpa", "previous_semester_gpa", "semester gpa", "semester_gpa", "gpa", "grades", "grade"],
    "grades": ["previous semester gpa", "previous_semester_gpa", "semester gpa", "semester_gpa", "gpa", "grades", "grade"],
    "sleep": ["sleep", "sleep hours", "sleep_hours_per_night", "sleep hours per night", "hours slept"],
    "sleep hours": ["sleep", "sleep hours", "sleep_hours_per_night", "sleep hours per night", "hours slept"],
    "productivity": ["productivity", "productivity score", "productivity_score", "performance"],
    "stress": ["stress", "stress level", "stress_level"],
    "screen time": ["screen time", "screen_time_hours", "screen hours", "phone time"],
    "social media": ["social media", "social_media_hours", "social hours"],
    "part time": ["part time", "part_time_job", "part time job", "job"],
    "performance": ["performance", "performance category", "performance_category"],
    "gender": ["gender", "sex"],
    "delivery time": ["delivery time", "delivery days", "delivery_days", "days to deliver"],
    "shipping": ["shipping", "shipping method", "shipping_method", "ship mode", "delivery method"],
    "returned": ["returned", "return", "is returned", "return status", "returned_flag"],
    "order amount": ["order amount", "order_amount", "amount", "revenue", "total"],
    "salary": ["salary", "salary midpoint", "salary_midpoint", "salary_midpoint_lpa", "salary_lpa"],
    "rating": ["rating", "company rating", "company_rating"],
    "experience": ["experience", "min experience", "max experience", "experience tier"],
}
# Most values a column may have to be searched for in questions.
MENTIONED_VALUES = 80


def _has_any(text: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return test


def intent_tags(df: DataFrame, question: str) -> DataFrame:
    """Adds ``intent`` and ``confidence`` by ordered keyword rules."""
    q = F.lower(ref(question))
    comparators = sum((q.contains(w).cast("int") for w in COMPARATORS), F.lit(0))
    intent = (
        F.when(_has_any(q, CHART_WORDS), "chart_lookup")
        .when(_has_any(q, METADATA_WORDS), "dataset_metadata")
        .when(_has_any(q, RELATION_WORDS), "correlation_query")
        .when(_has_any(q, COMPARE_WORDS) | (comparators >= 2), "compare_groups")
        .when(q.contains(" by ") | q.startswith("which "), "groupby_aggregation")
        .when(_has_any(q, (*AGGREGATE_WORDS, *CONDITION_WORDS)), "filtered_aggregation")
        .otherwise("unsupported")
    )
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    tagged = df.withColumn("intent", intent)
    return tagged.withColumn("confidence", F.element_at(sure, F.col("intent")))


def aggregate_word(df: DataFrame, question: str) -> DataFrame:
    """Adds ``aggregation``: the first aggregate word, mean when there is none."""
    q = F.lower(ref(question))
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, function in AGGREGATE_WORDS.items():
        choice = choice.when(q.contains(word), function)
    return df.withColumn("aggregation", choice.otherwise("mean"))


def numeric_predicates(df: DataFrame, key: str, question: str) -> DataFrame:
    """Rows (key, operator, low, high): the number comparisons of each question.

    ``high`` is filled for between only.  "no more than" means at most and is
    not also read as "more than".
    """
    q = F.replace(F.lower(ref(question)), F.lit("no more than"), F.lit("at most"))
    null = F.lit(None).cast("double")
    found = []

    def comparison(operator: str):
        return lambda v: F.struct(
            F.lit(operator).alias("operator"), v.cast("double").alias("low"), null.alias("high")
        )

    for pattern, operator in COMPARISON_PATTERNS:
        numbers = F.regexp_extract_all(q, F.lit(pattern), F.lit(1))
        found.append(F.transform(numbers, comparison(operator)))
    lows = F.regexp_extract_all(q, F.lit(BETWEEN_PATTERN), F.lit(1))
    highs = F.regexp_extract_all(q, F.lit(BETWEEN_PATTERN), F.lit(2))
    found.append(
        F.zip_with(
            lows,
            highs,
            lambda a, b: F.struct(
                F.lit("between").alias("operator"),
                a.cast("double").alias("low"),
                b.cast("double").alias("high"),
            ),
        )
    )
    every = F.array_distinct(F.concat(*found))
    return df.select(ref(key), F.inline(every))


# Lengths of the pieces of text by which values of wide columns meet questions.
PIECES = (1, 2, 4, 8, 16, 32)


def _wide_hits(asked: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (_key, column, value, wanted, at): values of columns with many values, found in questions.

    ``asked`` has _key and q, the normalised question.  A value is looked up by
    the piece of it that fewest values share, over half as long as itself (or
    the longest piece), so a common beginning brings nothing together.  Values
    longer than any question are in none.
    """
    longest = asked.agg(F.max(F.length("q"))).first()[0] or 0
    cells = [F.struct(F.lit(n).alias("column"), clean_text(ref(n), dtype_of(table, n)).alias("value")) for n in columns]
    values = table.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull()).distinct()
    values = values.withColumn("wanted", normalise(F.col("value"))).filter((F.col("wanted") != "") & (F.length("wanted") <= longest))
    size = F.lit(PIECES[0])
    for n in PIECES[1:]:
        size = F.when(F.length("wanted") >= n, n).otherwise(size)
    values = values.withColumn("size", size)
    own = F.expr("array_distinct(transform(sequence(1, length(wanted) - size + 1), i -> substring(wanted, i, size)))")
    offered = values.select("column", "value", "wanted", F.explode(own).alias("piece"))
    shared = offered.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = offered.join(shared.hint("merge"), "piece").groupBy("column", "value", "wanted").agg(F.min(F.struct("n", "piece")).alias("r"))
    rarest = rarest.select("column", "value", "wanted", F.col("r.piece").alias("piece"))
    # questions are cut into pieces of those lengths only that values are looked up by
    sizes = [r["size"] for r in values.select("size").distinct().collect()]
    cut_up = [F.expr(f"transform(sequence(1, length(q) - {n - 1}), i -> substring(q, i, {n}))") for n in sorted(sizes)]
    pieces = [F.when(F.length("q") >= n, c).otherwise(F.expr("array()")) for n, c in zip(sorted(sizes), cut_up)]
    none = F.expr("cast(array() as array<string>)")
    asked = asked.withColumn("piece", F.explode(F.array_distinct(F.concat(none, *pieces))))
    # the files tell nothing of the number of pieces: neither side may be taken for small and sent to the driver
    met = asked.join(rarest.hint("merge"), "piece").filter(F.col("q").contains(F.col("wanted")))
    return met.select("_key", "column", "value", "wanted", F.expr("locate(wanted, q)").alias("at"))


def _asked(questions: DataFrame, key: str, question: str) -> DataFrame:
    """Rows (_key, q): each question is normalised once, however many values it is searched for."""
    return questions.select(ref(key).alias("_key"), normalise(ref(question)).alias("q"))


def _texts(table: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return {n: clean_text(ref(n), dtype_of(table, n)) for n in columns}


def _wanted(values: Sequence[str], least: int) -> Column:
    """Array of (value, wanted), in order; the normal form has ``least`` characters at least.

    One literal, searched in a loop: a branch for each value would make plans of hundreds of branches.
    """
    pairs = [(v, w) for v in values if len(w := normalise_name(v)) >= least]
    lists = [F.array(*[F.lit(p[i]) for p in pairs]).cast("array<string>") for i in (0, 1)]
    return F.arrays_zip(lists[0].alias("value"), lists[1].alias("wanted"))


def _mentions(asked: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (_key, q, column, value): the first value of each column that a question mentions."""
    hits = []
    few = few_values(table, _texts(table, columns), MENTIONED_VALUES)
    for name, values in few.items():
        found = F.filter(_wanted(values, 2), lambda v: F.contains("q", v["wanted"]))
        hits.append(F.struct(F.lit(name).alias("column"), F.get(found, 0)["value"].alias("value")))
    none = F.expr("cast(array() as array<struct<column: string, value: string>>)")
    rows = asked.select("_key", F.inline(F.array(*hits) if hits else none)).filter(F.col("value").isNotNull())
    wide = [n for n in columns if n not in few]
    if wide:
        met = _wide_hits(asked, table, wide).filter(F.length("wanted") >= 2)
        rows = rows.unionByName(met.groupBy("_key", "column").agg(F.min("value").alias("value")))
    return rows


def value_mentions(
    questions: DataFrame, key: str, question: str, table: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Rows (key, column, value): the first value of each column, in value
    order, that a question mentions in normalised form.

    Few values become literals, so questions are matched in one scan; columns
    with more values meet the questions in a join.
    """
    return _mentions(_asked(questions, key, question), table, columns).withColumnRenamed("_key", key)


# Values that say yes or no, and the words that ask for them.
YES, NO = ("yes", "true", "1"), ("no", "false", "0")
RETURNED, RETURN_WORD = "returned", "return"
WITHOUT_WORDS = ("without", "not ")


def _flag_values(table: DataFrame, columns: Sequence[str]) -> dict[str, tuple[list, list]]:
    """Of each column, its values that say yes or ``returned``, and those that say no; one scan."""
    if not columns:
        return {}
    picks = []
    for i, text in enumerate(_texts(table, columns).values()):
        for j, words in enumerate(((*YES, RETURNED), NO)):
            picks.append(F.array_sort(F.collect_set(F.when(normalise(text).isin(*words), text))).alias(f"v{i}_{j}"))
    row = table.agg(*picks).first()
    return {n: (row[f"v{i}_0"], row[f"v{i}_1"]) for i, n in enumerate(columns)}


def _named(column: str) -> Column:
    """Does the question have a word of the column's name in it?"""
    return _has_any(F.col("q"), normalise_name(column).split())


def value_predicates(
    questions: DataFrame, key: str, question: str, table: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Rows (key, column, operator, values): the value conditions of each question.

    A mentioned value is asked for by ``==``.  Where no value of a column is
    mentioned, a question about returns asks a column of that name for its
    yes values, and one with "without" or "not" that has a word of the
    column's name asks for its no values, both by ``in``.
    """
    asked = _asked(questions, key, question)
    mentioned = _mentions(asked, table, columns)
    none = F.expr("cast(null as array<string>)")
    rules = []
    for name, (yes, no) in _flag_values(table, columns).items():
        wanted = none
        if no:
            wanted = F.when(_has_any(F.col("q"), WITHOUT_WORDS) & _named(name), F.array(*[F.lit(v) for v in no]))
        if yes and RETURN_WORD in normalise_name(name):
            wanted = F.when(F.col("q").contains(RETURN_WORD), F.array(*[F.lit(v) for v in yes])).otherwise(wanted)
        if yes or no:
            rules.append(F.struct(F.lit(name).alias("column"), wanted.alias("values")))
    equal = mentioned.select("_key", "column", F.lit("==").alias("operator"), F.array("value").alias("values"))
    if not rules:
        return equal.withColumnRenamed("_key", key)
    ruled = asked.select("_key", F.inline(F.array(*rules))).filter(F.col("values").isNotNull())
    ruled = ruled.join(mentioned.select("_key", "column"), ["_key", "column"], "left_anti")
    ruled = ruled.select("_key", "column", F.lit("in").alias("operator"), "values")
    return equal.unionByName(ruled).withColumnRenamed("_key", key)


def _spots(asked: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (_key, place, column, spots): where a question mentions values of a column, two at least."""
    found = []
    few = few_values(table, _texts(table, columns), MENTIONED_VALUES)
    for name, values in few.items():
        inside = F.filter(_wanted(values, 1), lambda v: F.contains("q", v["wanted"]))
        each = F.transform(inside, lambda v: F.struct(F.position(v["wanted"], F.col("q")).alias("at"), v["value"].alias("value")))
        found.append(F.struct(F.lit(columns.index(name)).alias("place"), F.lit(name).alias("column"), F.array_sort(each).alias("spots")))
    shape = "array<struct<place: int, column: string, spots: array<struct<at: int, value: string>>>>"
    rows = asked.select("_key", F.inline(F.array(*found).cast(shape) if found else F.expr(f"cast(array() as {shape})")))
    wide = [n for n in columns if n not in few]
    if wide:
        met = _wide_hits(asked, table, wide).groupBy("_key", "column")
        # no longer than the question is
        met = met.agg(F.array_sort(F.collect_set(F.struct("at", "value"))).alias("spots"))
        places = F.create_map(*[x for i, n in enumerate(columns) for x in (F.lit(n), F.lit(i))])
        rows = rows.unionByName(met.select("_key", F.element_at(places, F.col("column")).alias("place"), "column", "spots"))
    return rows.filter(F.size("spots") >= 2)


def group_mentions(
    questions: DataFrame, key: str, question: str, table: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Rows (key, column, first, second): the first column of which a question
    mentions two or more values, with the two mentioned first."""
    rows = _spots(_asked(questions, key, question), table, columns)
    best = rows.groupBy("_key").agg(F.min(F.struct("place", "column", "spots")).alias("g"))
    return best.select(
        F.col("_key").alias(key), "g.column", F.col("g.spots")[0]["value"].alias("first"), F.col("g.spots")[1]["value"].alias("second")
    )


def group_predicates(
    questions: DataFrame, key: str, question: str, table: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Rows (key, column, first, second): values of the two groups that a question compares.

    Of the first column that gives any: the two values mentioned first, or,
    for a question with "without" and a word of the column's name, the
    column's yes values and its no values.
    """
    asked = _asked(questions, key, question)
    spots = _spots(asked, table, columns)
    one = [F.array(F.col("spots")[i]["value"]) for i in (0, 1)]
    rows = spots.select("_key", "place", F.lit(0).alias("rule"), "column", one[0].alias("first"), one[1].alias("second"))
    rules = []
    for place, (name, (yes, no)) in enumerate(_flag_values(table, columns).items()):
        yes = [v for v in yes if normalise_name(v) in YES]
        if yes and no:
            sides = [F.array(*[F.lit(v) for v in side]) for side in (yes, no)]
            pick = F.struct(F.lit(place).alias("place"), F.lit(1).alias("rule"), F.lit(name).alias("column"), sides[0].alias("first"), sides[1].alias("second"))
            rules.append(F.when(F.col("q").contains(WITHOUT_WORDS[0]) & _named(name), pick))
    if rules:
        rows = rows.unionByName(asked.select("_key", F.inline(F.array_compact(F.array(*rules)))))
    best = rows.groupBy("_key").agg(F.min(F.struct("place", "rule", "column", "first", "second")).alias("g"))
    return best.select(F.col("_key").alias(key), "g.column", "g.first", "g.second")


def column_scores(phrase: Column, columns: Sequence[str]) -> Column:
    """Array of (column, score) structs for one phrase; columns are few."""
    text = normalise(phrase)
    words = F.filter(F.split(text, " "), lambda w: w != "")
    active = {k: text.contains(k) for k in ALIASES}
    added = [
        F.when(
            test,
            F.array(*[F.lit(w) for w in _alias_words(key)]),
        ).otherwise(F.array().cast("array<string>"))
        for key, test in active.items()
    ]
    expanded = F.array_distinct(F.concat(words, *added))
    scores = []
    for name in columns:
        plain = normalise_name(name)
        parts = set(plain.split())
        tokens = F.array(*[F.lit(w) for w in sorted(parts)]).cast("array<string>")
        score = F.size(F.array_intersect(expanded, tokens)) * 3
        overlap = F.lit(plain).contains(text) | text.contains(plain)
        score = score + F.when(overlap, 6).otherwise(0)
        for key, test in active.items():
            named = any(
                normalise_name(v) == plain or set(normalise_name(v).split()) <= parts
                for v in ALIASES[key]
            )
            if named:
                score = score + F.when(test, 10).otherwise(0)
        score = score + F.size(F.filter(expanded, F.lit(plain).contains))
        scores.append(F.struct(F.when(text != "", score).otherwise(0).alias("score"), F.lit(name).alias("column")))
    return F.array(*scores)


def _alias_words(key: str) -> list[str]:
    words = set()
    for value in ALIASES[key]:
        words.update(value.split())
        words.update(normalise_name(value).split())
    return sorted(words)


def column_match(df: DataFrame, key: str, phrase: str, columns: Sequence[str]) -> DataFrame:
    """Rows (key, phrase, matched, score): the column a phrase means.

    A tie for the best score, or no score at all, matches nothing; so does a
    phrase that is itself an alias without an alias match.
    """
    text = normalise(ref(phrase))
    scored = df.select(
        ref(key), ref(phrase), text.alias("_t"), column_scores(ref(phrase), columns).alias("_s")
    )
    best = F.array_max(F.transform("_s", lambda s: s["score"]))
    winners = F.filter("_s", lambda s: s["score"] == F.col("_best"))
    aliased = F.col("_t").isin(*ALIASES) & (F.col("_best") < 10)
    sure = (F.col("_best") > 0) & (F.size("_w") == 1) & ~aliased
    return (
        scored.withColumn("_best", best)
        .withColumn("_w", winners)
        .select(
            ref(key),
            ref(phrase),
            F.when(sure, F.col("_w")[0]["column"]).alias("matched"),
            F.col("_best").alias("score"),
        )
    )
