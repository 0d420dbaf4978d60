"""TX: posts, mentions, links, reports."""

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import textops as X
from ..plans.tables import table
from .base import docs, query, texts

POSTS = """posts AS (SELECT page_id, 'see ' || url || ' by @user' || page_id || ' ' || html AS text FROM pages)"""
URLS = POSTS + f""",
urls AS (SELECT page_id, unnest(l) AS url, (generate_subscripts(l, 1) - 1)::INT AS pos
   FROM (SELECT page_id, regexp_extract_all(text, '{L.URL_PATTERN}') AS l FROM posts)),
short AS (SELECT url, 'http://sh.ort/' || code || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END AS short FROM (
   SELECT url, code, row_number() OVER (PARTITION BY code ORDER BY url) AS n FROM (
   SELECT url, translate(substr(md5(url), 1, 5), '0123456789abcdef', 'abcdefghijklmnop') AS code
   FROM (SELECT DISTINCT url FROM urls)))),
names AS (SELECT page_id, unnest(l) AS name, (generate_subscripts(l, 1) - 1)::INT AS pos
   FROM (SELECT page_id, regexp_extract_all(text, '@([a-zA-Z0-9]+)', 1) AS l FROM posts))"""
FREQ = """f AS (SELECT doc_id, word, count(*) AS freq,
   row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS rnk
   FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents)
   GROUP BY doc_id, word)"""


def posts(spark, d):
    p = table(spark, d, "pages")
    text = F.concat(F.lit("see "), "url", F.lit(" by @user"), F.col("page_id").cast("string"), F.lit(" "), "html")
    return p.select("page_id", text.alias("text"))


@query("TX-01", """WITH m AS (SELECT doc_id, regexp_extract_all(text, '@([a-zA-Z0-9]+)', 1) AS l FROM documents)
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS name FROM m""")
def _(spark, d):
    return X.mentions(texts(spark, d), "doc_id")


@query("TX-02", f"WITH {URLS} SELECT page_id, pos, url FROM urls")
def _(spark, d):
    return X.find_urls(posts(spark, d), "page_id")


@query("TX-03", f"WITH {URLS} SELECT url, short FROM short")
def _(spark, d):
    return X.shorten(X.find_urls(posts(spark, d), "page_id"))


@query("TX-04", f"""WITH {URLS},
a AS (SELECT page_id, string_agg(name, ' ' ORDER BY pos) AS user_names FROM names GROUP BY 1),
b AS (SELECT page_id, string_agg(url || '>' || short, ' ' ORDER BY pos) AS urls FROM urls JOIN short USING (url) GROUP BY 1)
SELECT page_id, user_names, urls FROM a FULL JOIN b USING (page_id)""")
def _(spark, d):
    p = posts(spark, d)
    found = X.find_urls(p, "page_id")
    out = X.create_posts(X.mentions(p, "page_id"), found.join(X.shorten(found), "url"), "page_id")
    pair = F.transform("urls", lambda u: F.concat_ws(">", u["url"], u["short"]))
    return out.select("page_id", F.array_join("user_names", " ").alias("user_names"),
                      F.array_join(pair, " ").alias("urls"))


@query("TX-05", """SELECT doc_id, len(l) AS count, array_to_string(l, ' ') AS words
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS l FROM documents)""")
def _(spark, d):
    t = X.simple_tokens(texts(spark, d))
    return t.select("doc_id", "count", F.array_join("words", " ").alias("words"))


@query("TX-06", f"""WITH {FREQ} SELECT doc_id, string_agg(word || ':' || freq, ' ' ORDER BY rnk)
FILTER (WHERE rnk <= 10) AS top_words, count(*) AS unique_count, sum(freq)::BIGINT AS total_count FROM f GROUP BY 1""")
def _(spark, d):
    s = X.text_stats(docs(spark, d), "doc_id", k=10)
    top = F.transform("top_words", lambda w: F.concat_ws(":", w["word"], w["freq"].cast("string")))
    return s.select("doc_id", F.array_join(top, " ").alias("top_words"), "unique_count", "total_count")


@query("TX-07", f"""WITH {FREQ} SELECT doc_id, 'Text analysis: ' || sum(freq)::BIGINT || ' words, ' || count(*) ||
' unique. Top: ' || string_agg(word || '(' || freq || ')', ', ' ORDER BY rnk) FILTER (WHERE rnk <= 5) AS report
FROM f GROUP BY 1""")
def _(spark, d):
    return X.text_report(X.text_stats(docs(spark, d), "doc_id")).select("doc_id", "report")
