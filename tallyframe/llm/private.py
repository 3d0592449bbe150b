"""Personal data in texts: patterns propose spans, checksums confirm them, context sets the score.

Everything is a built-in SQL function.  A pattern's matches and the text
between them (its pieces) have known lengths, so running totals of those are
the positions of the spans, in one pass however long the text is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import without

# What the patterns match is given; possessive quantifiers and the
# look-behinds only keep the search linear in the length of a text.
EMAIL = r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_BLOCK = r"(?<![0-9])[0-9]{13,19}+(?![0-9])"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}
ACCOUNTS = "|".join(f"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())
IBAN = f"(?<![A-Za-z0-9])(?:{ACCOUNTS})(?![A-Za-z0-9])"
# Characters before and after a span in which context words count.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``valid`` keeps a match; a base kind reports each valid match, another one
    only those whose score reaches the threshold.  Words near a span that
    speak for it or against it move the score from ``score``.
    """

    name: str
    pattern: str
    needs: str
    valid: str
    base: bool
    score: float
    words: str
    against: str = "(?i)version|isbn|invoice|serial"


LUHN = """aggregate(sequence(1, length({d})), 0, (sum, i) -> sum + CASE
 WHEN (length({d}) - i) % 2 = 0 THEN ascii(substr({d}, i, 1)) - 48
 WHEN ascii(substr({d}, i, 1)) >= 53 THEN 2 * (ascii(substr({d}, i, 1)) - 48) - 9
 ELSE 2 * (ascii(substr({d}, i, 1)) - 48) END) % 10 = 0"""
DIGITS = r"regexp_replace(m, '[\\x20-]', '')"
COMPACT = r"replace(m, ' ', '')"
TURNED = f"concat(substr({COMPACT}, 5), substr({COMPACT}, 1, 4))"
# letters count as 10 to 35: two digits
MOD97 = f"""aggregate(sequence(1, length({TURNED})), 0, (r, i) -> CASE
 WHEN ascii(substr({TURNED}, i, 1)) >= 65 THEN (r * 100 + ascii(substr({TURNED}, i, 1)) - 55) % 97
 ELSE (r * 10 + ascii(substr({TURNED}, i, 1)) - 48) % 97 END) = 1"""

KINDS = (
    Kind("email", EMAIL, "@", "true", True, 0.8, "(?i)mail|contact|kontakt|correo|courriel"),
    Kind("ip", IP, ".", f"m RLIKE r'^{PART}(?:\\.{PART}){{3}}$'", True, 0.6, "(?i)address|host|server|client|login"),
    Kind("card", CARD, "", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN.format(d=DIGITS)}", True, 0.9, "(?i)card|visa|karte|tarjeta|carte|payment"),
    Kind("phone", PHONE, "+", r"length(regexp_replace(m, '[^0-9]', '')) BETWEEN 8 AND 15", True, 0.6, "(?i)phone|call|tel|fax|mobile"),
    Kind("iban", IBAN, "", MOD97, False, 0.8, "(?i)iban|konto|account|bank|cuenta|compte"),
    Kind("card_block", CARD_BLOCK, "", LUHN.format(d="m"), False, 0.7, "(?i)card|visa|karte|tarjeta|carte|payment"),
)
# Least score of a span that is not of a base kind.
THRESHOLD = 0.5
BLOCK = 256


def running_totals(lengths: str) -> str:
    """SQL: for each element of an array of numbers, the sum of those before it.

    Within blocks, whose own sums are totalled first: arrays are copied at each
    step, so one pass over everything would take quadratic time.
    """
    sums = f"transform(sequence(0, size({lengths}) - 1, {BLOCK}), b -> aggregate(slice({lengths}, b + 1, {BLOCK}), 0L, (s, x) -> s + x))"
    totals = "aggregate({}, named_struct('s', {}, 'all', cast(array() as array<bigint>)), (t, x) -> named_struct('s', t.s + x, 'all', concat(t.all, array(t.s))), t -> t.all)"
    starts = totals.format(sums, "0L")
    return f"flatten(transform({starts}, (first, b) -> {totals.format(f'slice({lengths}, b * {BLOCK} + 1, {BLOCK})', 'first')}))"


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Rows (key, found): an array of (kind, start, end, score, base), by kind as listed, then start.

    Whole texts are searched, leftmost and without overlaps for each kind; a
    match that is not valid is dropped and its text is not searched again.
    Positions count code points, the end not included.  A solid block of digits
    within a base card counts once, as the card.  Null and empty texts give
    empty arrays; repeated rows are searched each; other columns are left out.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digit", F.expr("text RLIKE '[0-9]'"))
    names = []
    for kind in kinds:
        k = kind.name
        likely = F.col("text").contains(kind.needs) if kind.needs else F.lit(True)
        likely = likely if k == "email" else F.col("digit") & likely
        pattern = F.lit(kind.pattern)
        empty = F.expr("cast(array() as array<string>)")
        rows = rows.withColumn(f"{k}_m", F.when(likely, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(empty))
        rows = rows.withColumn(f"{k}_p", F.when(F.size(f"{k}_m") > 0, F.split("text", kind.pattern, -1)).otherwise(empty))
        names.append(k)
    rows = rows.drop("text", "digit")
    for kind in kinds:
        k = kind.name
        rows = rows.withColumn(f"{k}_l", F.expr(f"transform({k}_m, (m, i) -> cast(length({k}_p[i]) + length(m) as bigint))"))
        rows = rows.withColumn(f"{k}_s", F.when(F.size(f"{k}_m") > 0, F.expr(running_totals(f"{k}_l"))).otherwise(F.expr("cast(array() as array<bigint>)")))
        score = (
            f"{kind.score}D + CASE WHEN right({k}_p[i], {CONTEXT}) RLIKE '{kind.words}' OR left({k}_p[i + 1], {CONTEXT}) RLIKE '{kind.words}' THEN 0.1D ELSE 0D END"
            f" - CASE WHEN right({k}_p[i], {CONTEXT}) RLIKE '{kind.against}' THEN 0.3D ELSE 0D END"
        )
        spans = F.expr(
            f"filter(transform({k}_m, (m, i) -> CASE WHEN {kind.valid} THEN named_struct('kind', '{k}', 'start', {k}_s[i] + length({k}_p[i]),"
            f" 'end', {k}_s[i] + length({k}_p[i]) + length(m), 'score', round({score}, 2), 'base', {str(kind.base).lower()}) END),"
            f" x -> x IS NOT NULL AND (x.base OR x.score >= {THRESHOLD}D))"
        )
        rows = rows.withColumn(f"{k}_x", spans)
    if "card" in names and "card_block" in names:
        inside = "exists(card_x, c -> c.start <= x.start AND x.end <= c.end)"
        rows = rows.withColumn("card_block_x", F.expr(f"filter(card_block_x, x -> NOT {inside})"))
    return rows.select(F.col("key").alias(key), F.concat(*[f"{k}_x" for k in names]).alias("found"))


def with_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of each row as column private (one so named is replaced)."""
    docs = without(docs, ["private"])
    packed = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = find_private(packed, "row", "text")
    return found.select("row.*", F.col("found").alias("private"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as text."""
    found = find_private(docs.select("doc_id", "text"))
    base = F.filter("found", lambda x: x["base"])
    counts = [
        F.expr(f"cast(size(filter(found, x -> x.kind = '{k.name}')) as long)").alias(f"n_{k.name}")
        for k in KINDS
        if k.base
    ]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _oracle_kind(name: str, pattern: str, valid: str) -> str:
    return f"""{name}_a AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d),
{name}_x AS (SELECT doc_id, list_filter(list_transform(range(1, len(ms) + 1), lambda i: CASE WHEN {valid} THEN
 {{'kind': '{name}', 'b': list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0), 'n': length(ms[i])}} END), lambda x: x IS NOT NULL) AS xs FROM {name}_a)"""


_ORACLE_DIGIT = "(ascii({d}[len({d}) - j]) - 48)"
_ORACLE_LUHN = "list_sum(list_transform(range(0, len({d})), lambda j: CASE WHEN j % 2 = 0 THEN {x} WHEN {x} >= 5 THEN 2 * {x} - 9 ELSE 2 * {x} END)) % 10 = 0"


def _oracle_luhn(d: str) -> str:
    return _ORACLE_LUHN.replace("{x}", _ORACLE_DIGIT).replace("{d}", d)


_ORACLE_TEXT = "concat_ws(':', x.kind, x.b::BIGINT, (x.b + x.n)::BIGINT)"
_ORACLE_IBAN = "regexp_extract(substr(t, b + 1, 70), '^(?:" + ACCOUNTS + ")')"
_ORACLE_TURNED = "(c[5:] || c[1:4])"
_ORACLE_AGAINST = "regexp_matches(right(substr(t, 1, b::BIGINT), 40), '(?i)version|isbn|invoice|serial')"
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_oracle_kind("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true")},
{_oracle_kind("ip", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(ms[i], '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 999) > 255)) = 0")},
{_oracle_kind("card", "[0-9](?:[\\x20-]?[0-9])+", "len(regexp_replace(ms[i], '[ -]', '', 'g')) BETWEEN 16 AND 19 AND " + _oracle_luhn("regexp_replace(ms[i], '[ -]', '', 'g')"))},
{_oracle_kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "len(regexp_replace(ms[i], '[^0-9]', '', 'g')) BETWEEN 8 AND 15")},
{_oracle_kind("card_block", "[0-9]+", "len(ms[i]) BETWEEN 13 AND 19 AND " + _oracle_luhn("ms[i]"))},
{_oracle_kind("code", "[A-Z]{2}[0-9]{2}", "true")},
blocks AS (SELECT *, x.b AS b FROM (SELECT doc_id, t, unnest(list_filter(b.xs, lambda x: len(list_filter(c.xs, lambda y: y.b <= x.b AND x.b + x.n <= y.b + y.n)) = 0)) AS x
 FROM card_block_x b JOIN card_x c USING (doc_id) JOIN d USING (doc_id))),
ibans AS (SELECT doc_id, b, m, replace(m, ' ', '') AS c FROM (SELECT doc_id, t, b, {_ORACLE_IBAN} AS m FROM (SELECT doc_id, t, unnest(xs).b::BIGINT AS b FROM code_x JOIN d USING (doc_id)))
 WHERE m <> '' AND NOT regexp_matches(substr(t, b, 1), '[A-Za-z0-9]') AND NOT regexp_matches(substr(t, b + len(m) + 1, 1), '[A-Za-z0-9]')),
more AS (SELECT doc_id, 1 AS k, x.b AS b, {_ORACLE_TEXT} AS span FROM blocks WHERE NOT {_ORACLE_AGAINST}
 UNION ALL SELECT doc_id, 0, b, concat_ws(':', 'iban', b, b + len(m)) FROM ibans WHERE list_reduce(list_prepend(0, list_transform(range(1, len(c) + 1), lambda i: ascii({_ORACLE_TURNED}[i]))), lambda r, v: CASE WHEN v >= 65 THEN (r * 100 + v - 55) % 97 ELSE (r * 10 + v - 48) % 97 END) = 1),
extra AS (SELECT doc_id, list(span ORDER BY k, b) AS spans FROM more GROUP BY 1),
base AS (SELECT doc_id, len(email_x.xs) AS n_email, len(ip_x.xs) AS n_ip, len(card_x.xs) AS n_card, len(phone_x.xs) AS n_phone,
 list_transform(email_x.xs || ip_x.xs || card_x.xs || phone_x.xs, lambda x: {_ORACLE_TEXT}) AS spans
 FROM email_x JOIN ip_x USING (doc_id) JOIN card_x USING (doc_id) JOIN phone_x USING (doc_id))
SELECT doc_id, n_email, n_ip, n_card, n_phone, sha256(array_to_string(base.spans, ',')) AS base_sha256,
 array_to_string(base.spans || coalesce(extra.spans, []), ',') AS spans FROM base LEFT JOIN extra USING (doc_id)"""
