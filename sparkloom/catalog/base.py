"""Registration of queries with their checks, and shared SQL fragments for the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import colocate, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under the inventory id ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double at the query boundary (never inside operators)."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as scanned, for work that stays inside the row or has one global aggregation."""
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed by their id, for work with several per-document steps."""
    return colocate(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


# ---- shared CTEs of the checks ----
def clean(column: str) -> str:
    """Blank out words that hold a letter outside ASCII or an underscore (chr(1)), keeping their place."""
    return (
        f"regexp_replace(regexp_replace({column}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', chr(2), 'g'), "
        f"'[A-Za-z0-9_]*(?:_|[^\\x00-\\x7F])(?:[A-Za-z0-9_]|[^\\x00-\\x7F])*', chr(1), 'g')"
    )


WORD_SQL = "[a-zA-Z0-9](?:[a-zA-Z0-9'']*[a-zA-Z0-9])?"


def sql_words(column: str) -> str:
    return f"regexp_extract_all({clean(column)}, '{WORD_SQL}')"


TOK = f"""
tok AS (SELECT doc_id, unnest(l) AS token, (generate_subscripts(l, 1) - 1)::INT AS pos
        FROM (SELECT doc_id, {sql_words('text')} AS l FROM documents))"""

CNT = TOK + """,
cnt AS (SELECT doc_id, lower(token) AS word, count(*) AS freq FROM tok GROUP BY ALL)"""

SENT = f"""
sent AS (SELECT doc_id, unnest(l) AS sentence, (generate_subscripts(l, 1) - 1)::INT AS sent_idx FROM (
   SELECT doc_id, list_filter(list_transform(string_split(
       regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(30) || '\\2', 'g'), chr(30)),
       lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10) AS l
   FROM documents)),
swc AS (SELECT doc_id, sent_idx, lower(w) AS word, count(*) AS n
        FROM (SELECT doc_id, sent_idx, unnest({sql_words('sentence')}) AS w FROM sent) GROUP BY ALL)"""


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def sql_tag(word: str) -> str:
    from ..functions import lexicon as L

    w = f"lower({word})"
    arms = [f"WHEN {w} IN {sql_list(words)} THEN '{name}'" for name, words in L.TAG_WORDS]

    def suffix(words):
        return f"regexp_matches({w}, '(?:{'|'.join(words)})$')"

    arms += [
        f"WHEN {w} LIKE '%ly' AND length({w}) > 4 THEN 'ADV'",
        f"WHEN {suffix(L.VERB_SUFFIXES)} THEN 'VERB'",
        f"WHEN {suffix(L.NOUN_SUFFIXES)} THEN 'NOUN'",
        f"WHEN {suffix(L.ADJECTIVE_SUFFIXES)} THEN 'ADJ'",
        f"WHEN regexp_matches({word}, '^[A-Z]') AND length({word}) > 1 THEN 'PROPN'",
        f"WHEN regexp_matches({w}, '^[0-9]+$') THEN 'NUM'",
    ]
    return "CASE " + " ".join(arms) + " ELSE 'NOUN' END"


TAG = TOK + f""",
tag AS (SELECT doc_id, pos, token, {sql_tag('token')} AS tag FROM tok)"""


def sql_grams(name: str, n: int, k: int) -> str:
    """CTE ``name(doc_id, gram, freq, rnk)`` of the top ``k`` n-grams; needs ``tok``."""
    leads = " || ' ' || ".join(
        ["lower(token)"] + [f"lower(lead(token, {i}) OVER (PARTITION BY doc_id ORDER BY pos))" for i in range(1, n)])
    return f"""
{name} AS (SELECT * FROM (SELECT doc_id, gram, count(*) AS freq,
      row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) AS rnk
      FROM (SELECT doc_id, {leads} AS gram FROM tok) WHERE gram IS NOT NULL GROUP BY doc_id, gram) WHERE rnk <= {k})"""
