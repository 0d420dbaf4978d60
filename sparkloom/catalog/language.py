"""NL: tokens, sentences, tags, n-grams, vocabulary."""

from pyspark.sql import functions as F

from ..operators import phrases as P
from ..operators import tokens as T
from .base import CNT, SENT, TAG, TOK, docs, query, r, sql_grams, sql_words, texts


@query("NL-01", f"WITH {TOK} SELECT doc_id, pos, token FROM tok")
def _(spark, d):
    return T.tokens(texts(spark, d))


@query("NL-02", f"""WITH {SENT} SELECT doc_id, sent_idx, sentence, len({sql_words('sentence')})::INT AS n_tokens
FROM sent""")
def _(spark, d):
    return T.sentences(texts(spark, d))


@query("NL-03", f"WITH {TAG} SELECT doc_id, pos, token, tag FROM tag")
def _(spark, d):
    return T.pos_tag(T.tokens(texts(spark, d)))


@query("NL-04", f"WITH {TAG} SELECT doc_id, tag, count(*) AS n FROM tag GROUP BY ALL")
def _(spark, d):
    return T.pos_distribution(T.pos_tag(T.tokens(texts(spark, d))))


def _grams(n, k):
    @query(f"NL-05-{n}", f"WITH {TOK}, {sql_grams('g', n, k)} SELECT doc_id, gram, freq, rnk::INT AS rnk FROM g")
    def _(spark, d):
        return P.ngrams(docs(spark, d), n, k)


for _n, _k in ((2, 100), (3, 80), (4, 50)):
    _grams(_n, _k)


@query("NL-06", f"""WITH {CNT} SELECT doc_id, sum(freq)::BIGINT AS total_words, count(*) AS vocab_size,
count(*) FILTER (WHERE freq = 1) AS hapax_count, round(count(*) / greatest(sum(freq), 1), 6) AS ttr
FROM cnt GROUP BY 1""")
def _(spark, d):
    return T.vocab_stats(T.word_counts(docs(spark, d))).withColumn("ttr", r("ttr"))


@query("NL-07", f"""WITH {CNT}, z AS (SELECT *, row_number() OVER w AS zipf_rank, first_value(freq) OVER w AS f1
FROM cnt WINDOW w AS (PARTITION BY doc_id ORDER BY freq DESC, word))
SELECT doc_id, word, freq, zipf_rank::INT AS zipf_rank, round(f1 / zipf_rank, 6) AS expected,
round(abs(freq - f1 / zipf_rank) / greatest(f1 / zipf_rank, 1.0), 6) AS deviation FROM z WHERE zipf_rank <= 50""")
def _(spark, d):
    z = T.zipf(T.word_counts(docs(spark, d)), 50)
    return z.withColumn("expected", r("expected")).withColumn("deviation", r("deviation"))


@query("NL-08", f"WITH {CNT} SELECT doc_id, length(word)::INT AS len, sum(freq)::BIGINT AS n FROM cnt GROUP BY 1, 2")
def _(spark, d):
    return T.length_hist(T.word_counts(docs(spark, d)))


COOC = """
topw AS (SELECT doc_id, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, word) AS k
   FROM cnt) WHERE k <= 150),
kept AS (SELECT t.doc_id, t.pos, lower(t.token) AS word FROM tok t JOIN topw w
   ON t.doc_id = w.doc_id AND lower(t.token) = w.word),
cooc AS (SELECT * FROM (SELECT a.doc_id, least(a.word, b.word) AS word1, greatest(a.word, b.word) AS word2,
   count(*) AS n, row_number() OVER (PARTITION BY a.doc_id ORDER BY count(*) DESC, least(a.word, b.word),
   greatest(a.word, b.word)) AS rnk
   FROM (SELECT *, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS s FROM kept) a JOIN kept b
   ON a.doc_id = b.doc_id AND b.pos = a.pos + a.s GROUP BY 1, 2, 3) WHERE rnk <= 200)"""


@query("NL-09", f"WITH {CNT}, {COOC} SELECT doc_id, word1, word2, n, rnk::INT AS rnk FROM cooc")
def _(spark, d):
    return P.cooccurrence(docs(spark, d), 5, 150, 200)


@query("NL-10", f"WITH {SENT} SELECT doc_id, sent_idx, word, n FROM swc")
def _(spark, d):
    return T.sent_word_counts(T.sentences(docs(spark, d)))
