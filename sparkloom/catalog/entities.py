"""NA: entities, collocations, richness, readability."""

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import analysis as A
from ..operators import phrases as P
from ..operators import tokens as T
from .base import CNT, SENT, TAG, TOK, clean, docs, query, r, sql_grams, sql_list, sql_words, texts
from .language import COOC

_KNOWN = ", ".join(f"({i}, '{t}', '{t.title()}', '{k}')" for i, (t, k) in enumerate(L.KNOWN_ENTITIES))


def _hits(pattern):
    return (f"(SELECT doc_id, sent_idx, unnest(l) AS h, (generate_subscripts(l, 1) - 1)::INT AS i FROM "
            f"(SELECT doc_id, sent_idx, regexp_extract_all({clean('sentence')}, '{pattern}') AS l FROM sent))")


ENT = SENT + f""",
ent_dict AS (SELECT doc_id, sent_idx, 0 AS method, k::INT AS ord, title AS text, type FROM sent,
   (VALUES {_KNOWN}) known(k, term, title, type) WHERE contains(lower(sentence), term)),
ent_pat AS (SELECT doc_id, sent_idx, 1 AS method, i AS ord, h AS text,
   CASE WHEN regexp_split_to_array(lower(h), '\\s+')[1] IN {sql_list(L.PERSON_TITLES)} THEN 'PERSON'
        WHEN list_has_any(regexp_split_to_array(lower(h), '\\s+'), {list(L.ORG_SUFFIXES)}) THEN 'ORG'
        ELSE 'ENTITY' END AS type
   FROM {_hits('\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')}
   WHERE lower(h) NOT IN {sql_list(t for t, _ in L.KNOWN_ENTITIES)}),
ent_misc AS (SELECT doc_id, sent_idx, 2 AS method, i AS ord, h AS text, 'DATE' AS type
   FROM {_hits('\\b(?:1[89][0-9]{2}|20[0-2][0-9])\\b')}
   UNION ALL SELECT doc_id, sent_idx, 3, i, h, 'ACRONYM' FROM {_hits('\\b[A-Z]{2,6}\\b')}
   WHERE lower(h) NOT IN {sql_list(L.NOT_ACRONYMS)}),
ent AS (SELECT * FROM ent_dict UNION ALL SELECT * FROM ent_pat UNION ALL SELECT * FROM ent_misc),
uent AS (SELECT doc_id, lower(text) AS entity, type, arg_min(text, sent_idx::BIGINT * 1000000000 + method * 100000000 + ord) AS text,
   count(*) AS mentions FROM ent GROUP BY doc_id, lower(text), type)"""
BAGS = ENT + """,
bags AS (SELECT doc_id, entity, word, sum(n)::BIGINT AS n FROM (SELECT DISTINCT doc_id, entity FROM uent) u
   JOIN sent s USING (doc_id) JOIN swc USING (doc_id, sent_idx)
   WHERE contains(lower(s.sentence), entity) AND word <> entity AND length(word) > 2 GROUP BY ALL)"""
CTX = BAGS + """,
ctx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity ORDER BY n DESC, word) AS rnk FROM bags)
   WHERE rnk <= 30)"""
SIM = """
nrm AS (SELECT doc_id, entity, sqrt(sum(n * n)) AS nn FROM bags GROUP BY ALL),
sim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, entity_a, entity_b) AS rnk
  FROM (SELECT a.doc_id, a.entity AS entity_a, b.entity AS entity_b,
    round(sum((a.n / na.nn) * (b.n / nb.nn)), 6) AS cosine FROM bags a JOIN bags b
    ON a.doc_id = b.doc_id AND a.word = b.word AND a.entity < b.entity
    JOIN nrm na ON na.doc_id = a.doc_id AND na.entity = a.entity
    JOIN nrm nb ON nb.doc_id = b.doc_id AND nb.entity = b.entity GROUP BY 1, 2, 3) WHERE cosine > 0.01) WHERE rnk <= 100)"""


def sents(spark, d):
    return T.sentences(texts(spark, d))


def ents(spark, d):
    return A.entities(T.sentences(docs(spark, d)))


def bags(spark, d):
    return A.entity_bags(docs(spark, d))


@query("NA-01", f"WITH {ENT} SELECT doc_id, sent_idx, ord, text, type FROM ent_dict")
def _(spark, d):
    return A.entities(sents(spark, d), [A.entities_dict]).drop("method")


@query("NA-02", f"WITH {ENT} SELECT doc_id, sent_idx, text, type FROM ent_pat")
def _(spark, d):
    return A.entities(sents(spark, d), [A.entities_pattern]).drop("method", "ord")


@query("NA-03", f"WITH {ENT} SELECT doc_id, sent_idx, method, text, type FROM ent_misc")
def _(spark, d):
    return A.entities(sents(spark, d), [A.entities_misc]).drop("ord")


@query("NA-04", f"""WITH {ENT} SELECT doc_id, type, count(*) AS n_unique, sum(mentions)::BIGINT AS n_found
FROM uent GROUP BY 1, 2""")
def _(spark, d):
    return A.entity_summary(ents(spark, d))


@query("NA-05", f"WITH {CTX} SELECT doc_id, entity, word, n, rnk::INT AS rnk FROM ctx")
def _(spark, d):
    return A.entity_contexts(bags(spark, d), 30)


@query("NA-06", f"WITH {BAGS}, {SIM} SELECT doc_id, entity_a, entity_b, cosine FROM sim")
def _(spark, d):
    return A.entity_similarity(bags(spark, d), 100)


def tags(spark, d):
    return T.pos_tag(T.tokens(docs(spark, d)))


TOPPOS = TAG + """,
tpos AS (SELECT * FROM (SELECT doc_id, tag, lower(token) AS word, count(*) AS freq, row_number() OVER (
   PARTITION BY doc_id, tag ORDER BY count(*) DESC, lower(token)) AS rnk FROM tag GROUP BY doc_id, tag, lower(token)) WHERE rnk <= 20)"""


@query("NA-07", f"WITH {TOPPOS} SELECT doc_id, tag, word, freq, rnk::INT AS rnk FROM tpos")
def _(spark, d):
    return A.top_per_pos(tags(spark, d), 20)


@query("NA-08", f"""WITH {TAG} SELECT doc_id, count(*) FILTER (WHERE tag IN {sql_list(L.CONTENT_TAGS)}) AS content,
count(*) AS total, round(count(*) FILTER (WHERE tag IN {sql_list(L.CONTENT_TAGS)}) / count(*), 6) AS density
FROM tag GROUP BY 1""")
def _(spark, d):
    return A.lexical_density(tags(spark, d)).withColumn("density", r("density"))


def sql_tag_grams(name, n, k=None):
    leads = " || ' ' || ".join(
        ["tag"] + [f"lead(tag, {i}) OVER (PARTITION BY doc_id ORDER BY pos)" for i in range(1, n)])
    cut = "" if k is None else f"WHERE rnk <= {k}"
    return f"""{name} AS (SELECT * FROM (SELECT doc_id, seq, count(*) AS n, row_number() OVER (PARTITION BY doc_id
  ORDER BY count(*) DESC, seq) AS rnk FROM (SELECT doc_id, {leads} AS seq FROM tag) WHERE seq IS NOT NULL
  GROUP BY 1, 2) {cut})"""


def _tag_grams(n, k):
    @query(f"NA-09-{n}", f"WITH {TAG}, {sql_tag_grams('g', n, k)} SELECT doc_id, seq, n, rnk::INT AS rnk FROM g")
    def _(spark, d):
        return A.pos_ngrams(docs(spark, d), n, k)


_tag_grams(2, 50)
_tag_grams(3, 80)


@query("NA-10", f"""WITH {TAG}, {sql_tag_grams('b', 2)}, {sql_tag_grams('u', 1)},
up AS (SELECT doc_id, seq, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM u),
bp AS (SELECT doc_id, split_part(seq, ' ', 1) AS t1, split_part(seq, ' ', 2) AS t2, n,
   n / sum(n) OVER (PARTITION BY doc_id) AS joint FROM b),
mi AS (SELECT bp.doc_id, t1, t2, n, round(log2(joint / (x.p * y.p)), 6) AS mi FROM bp
   JOIN up x ON x.doc_id = bp.doc_id AND x.seq = t1 JOIN up y ON y.doc_id = bp.doc_id AND y.seq = t2)
SELECT doc_id, t1, t2, n, mi FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(mi) DESC, t1, t2) AS k FROM mi)
WHERE k <= 60""")
def _(spark, d):
    return A.pos_mi(docs(spark, d), 60).select("doc_id", "t1", "t2", "n", r("mi").alias("mi"))


GRAMS = TOK + "," + sql_grams("bg", 2, 100) + "," + sql_grams("tg", 3, 80) + "," + sql_grams("fg", 4, 50)
PMI = GRAMS + """,
bw AS (SELECT doc_id, gram, freq, split_part(gram, ' ', 1) AS w1, split_part(gram, ' ', 2) AS w2,
   sum(freq) OVER (PARTITION BY doc_id) AS total FROM bg),
uw AS (SELECT doc_id, w, sum(freq) AS u FROM (SELECT doc_id, w1 AS w, freq FROM bw UNION ALL SELECT doc_id, w2, freq FROM bw)
   GROUP BY ALL),
pmi AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pmi DESC, gram) AS rnk FROM (
   SELECT bw.doc_id, gram, w1, w2, freq, round(log2((freq / total) / ((a.u / (total * 2)) * (b.u / (total * 2)))), 6) AS pmi
   FROM bw JOIN uw a ON a.doc_id = bw.doc_id AND a.w = w1 JOIN uw b ON b.doc_id = bw.doc_id AND b.w = w2)),
vn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pmi DESC, gram) AS k FROM pmi
   WHERE regexp_matches(w1, '(?:{verb})$') AND (regexp_matches(w2, '(?:{noun})$') OR length(w2) > 3)) WHERE k <= 50),
pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rnk) AS k FROM tg
   WHERE split_part(gram, ' ', 2) IN {preps}) WHERE k <= 50)""".format(
    verb="|".join(L.PAIR_VERB_SUFFIXES), noun="|".join(L.PAIR_NOUN_SUFFIXES), preps=sql_list(L.PHRASE_PREPOSITIONS))


def pmi(spark, d):
    return P.bigram_pmi(docs(spark, d), 100, 100)


@query("NA-11", f"WITH {PMI} SELECT doc_id, gram, w1, w2, freq, pmi, rnk::INT AS rnk FROM pmi")
def _(spark, d):
    return pmi(spark, d).withColumn("pmi", r("pmi"))


@query("NA-12", f"""WITH {PMI} SELECT doc_id, 'verb_noun' AS kind, k::INT AS rnk, gram AS pattern, freq FROM vn
UNION ALL SELECT doc_id, 'prep', k::INT, gram, freq FROM pp UNION ALL SELECT doc_id, 'chain', rnk::INT, gram, freq FROM fg""")
def _(spark, d):
    return P.dep_patterns(docs(spark, d))


@query("NA-13-hubs", f"""WITH {PMI}, dg AS (SELECT doc_id, word, count(*) AS degree FROM (SELECT doc_id, w1 AS word FROM pmi
UNION ALL SELECT doc_id, w2 FROM pmi) GROUP BY ALL)
SELECT doc_id, word, degree, rnk::INT AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY degree DESC, word) AS rnk
FROM dg) WHERE rnk <= 30""")
def _(spark, d):
    return P.phrase_hubs(docs(spark, d), 30)


@query("NA-13-stats", f"""WITH {PMI}, nd AS (SELECT doc_id, count(DISTINCT word) AS n_nodes FROM (SELECT doc_id, w1 AS word FROM pmi
UNION ALL SELECT doc_id, w2 FROM pmi) GROUP BY 1),
en AS (SELECT doc_id, round(-sum(freq / total * log2(freq / total)), 6) AS entropy FROM bw GROUP BY 1)
SELECT doc_id, n_nodes, entropy FROM nd JOIN en USING (doc_id)""")
def _(spark, d):
    return P.phrase_graph_stats(docs(spark, d)).withColumn("entropy", r("entropy"))


RICH_COLS = ["simpson", "brunet_w", "honore_r", "yule_k", "sichel_s", "word_entropy", "hapax_ratio",
             "avg_word_length", "ttr"]


def sql_rich(name, top_n=None):
    cond = "TRUE" if top_n is None else f"rnk <= {top_n}"
    return f"""
{name} AS (SELECT doc_id, n, v, h, s / greatest(n * (n - 1), 1) AS simpson, pow(n, pow(v, -0.172)) AS brunet_w,
  100 * ln(n) / greatest(1 - h / v, 0.001) AS honore_r, 10000 * (m2 - n) / greatest(n * n, 1) AS yule_k,
  dis / v AS sichel_s, word_entropy, h / v AS hapax_ratio, chars / n AS avg_word_length, v / n AS ttr FROM (
  SELECT doc_id, max(n)::BIGINT AS n, count(*) AS v, count(*) FILTER (WHERE freq = 1) AS h,
  sum(freq * (freq - 1)) FILTER (WHERE {cond})::BIGINT AS s, sum(freq * freq) FILTER (WHERE {cond})::BIGINT AS m2,
  count(*) FILTER (WHERE {cond} AND freq = 2) AS dis,
  -sum(freq / n * log2(freq / n)) FILTER (WHERE {cond}) AS word_entropy, sum(length(word) * freq)::BIGINT AS chars
  FROM (SELECT *, sum(freq) OVER (PARTITION BY doc_id) AS n,
     row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, word) AS rnk FROM cnt) GROUP BY doc_id))"""


def _rich(suffix, top_n):
    cols = ", ".join(f"round({c}, 5) AS {c}" for c in RICH_COLS)

    @query(f"NA-14{suffix}", f"WITH {CNT}, {sql_rich('rich', top_n)} SELECT doc_id, n, v, h, {cols} FROM rich")
    def _(spark, d):
        out = A.lexical_richness(T.word_counts(docs(spark, d)), top_n)
        return out.select("doc_id", "n", "v", "h", *[r(c, 5).alias(c) for c in RICH_COLS])


_rich("", None)
_rich("-top50", 50)


@query("NA-14-spectrum", f"WITH {CNT} SELECT doc_id, freq, count(*) AS n_words FROM cnt GROUP BY ALL")
def _(spark, d):
    return A.frequency_spectrum(T.word_counts(docs(spark, d)))


@query("NA-15", f"""WITH {CNT}, z AS (SELECT * FROM (SELECT *, row_number() OVER w AS rk, first_value(freq) OVER w AS f1
FROM cnt WINDOW w AS (PARTITION BY doc_id ORDER BY freq DESC, word)) WHERE rk <= 50),
g AS (SELECT a / 10.0::DOUBLE AS a, b / 10.0::DOUBLE AS b FROM range(5, 25) t(a), range(0, 30) s(b)),
e AS (SELECT doc_id, a, b, round(sum(pow(freq - f1 / pow(rk + b, a), 2)), 6) AS sse FROM z, g GROUP BY ALL)
SELECT doc_id, a, b, sse FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sse, a, b) AS k FROM e) WHERE k = 1""")
def _(spark, d):
    return A.zipf_mandelbrot(T.zipf(T.word_counts(docs(spark, d)), 50))


SYLL = """greatest(len(regexp_extract_all(lower({w}), '[aeiouy]+')) -
   CASE WHEN lower({w}) LIKE '%e' AND lower({w}) NOT LIKE '%le' THEN 1 ELSE 0 END, 1)"""


@query("NA-16", f"WITH {CNT} SELECT DISTINCT word, {SYLL.format(w='word')}::INT AS syllables FROM cnt")
def _(spark, d):
    from ..functions.text import syllables, word_array

    words = texts(spark, d).select(F.explode(word_array(F.lower("text"))).alias("word")).distinct()
    return words.withColumn("syllables", syllables(F.col("word")))


READ = SENT + f""",
rd AS (SELECT doc_id, count(*) AS n_sent, sum(k)::BIGINT AS n_words, avg(k) AS avg_len,
   coalesce(stddev_samp(k), 0) AS std_len FROM (SELECT doc_id, len({sql_words('sentence')}) AS k FROM sent) GROUP BY 1),
sy AS (SELECT doc_id, sum({SYLL.format(w='word')} * n) AS syll, sum(length(word) * n) AS chars FROM swc GROUP BY 1),
read AS (SELECT d.doc_id, coalesce(n_sent, 0) AS n_sentences, coalesce(avg_len, 0) AS avg_sentence_length,
   coalesce(std_len, 0) AS std_sentence_length,
   coalesce(syll, 0) / greatest(coalesce(n_words, 0), 1) AS avg_syllables,
   coalesce(chars, 0) / greatest(coalesce(n_words, 0), 1) * 100 AS c100,
   coalesce(n_sent, 0) / greatest(coalesce(n_words, 0), 1) * 100 AS s100
   FROM documents d LEFT JOIN rd USING (doc_id) LEFT JOIN sy USING (doc_id)),
rdx AS (SELECT *, 206.835 - 1.015 * avg_sentence_length - 84.6 * avg_syllables AS flesch,
   0.39 * avg_sentence_length + 11.8 * avg_syllables - 15.59 AS fk_grade,
   0.0588 * c100 - 0.296 * s100 - 15.8 AS coleman_liau FROM read)"""
READ_COLS = ["avg_sentence_length", "std_sentence_length", "avg_syllables", "flesch", "fk_grade", "coleman_liau"]


@query("NA-17", f"WITH {READ} SELECT doc_id, n_sentences, {', '.join(f'round({c}, 6) AS {c}' for c in READ_COLS)} FROM rdx")
def _(spark, d):
    return A.readability(texts(spark, d)).select("doc_id", "n_sentences", *[r(c).alias(c) for c in READ_COLS])


COH = CNT + "," + SENT + """,
t100 AS (SELECT doc_id, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, word) AS k FROM cnt)
   WHERE k <= 100),
vec AS (SELECT doc_id, sent_idx, word, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, sent_idx)) AS x
   FROM swc JOIN t100 USING (doc_id, word)),
dots AS (SELECT a.doc_id, sum(a.x * b.x) AS dot, sum(a.x * b.x) FILTER (WHERE a.s = 1) AS adj
   FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS s FROM vec) a JOIN vec b
   ON a.doc_id = b.doc_id AND a.word = b.word AND b.sent_idx = a.sent_idx + a.s GROUP BY 1),
ns AS (SELECT doc_id, count(*) AS n, greatest(count(*) - 1, 0) + greatest(count(*) - 2, 0) + greatest(count(*) - 3, 0) +
   greatest(count(*) - 4, 0) + greatest(count(*) - 5, 0) AS np FROM sent GROUP BY 1),
coh AS (SELECT doc_id, n AS n_sentences, np AS n_pairs, coalesce(dot, 0) / greatest(np, 1) AS cohesion,
   coalesce(adj, 0) / greatest(n - 1, 1) AS adjacent_mean FROM ns LEFT JOIN dots USING (doc_id))"""


@query("NA-18", f"""WITH {COH} SELECT doc_id, n_sentences, n_pairs, round(cohesion, 6) AS cohesion,
round(adjacent_mean, 6) AS adjacent_mean FROM coh""")
def _(spark, d):
    c = P.cohesion(docs(spark, d))
    return c.withColumn("cohesion", r("cohesion")).withColumn("adjacent_mean", r("adjacent_mean"))


@query("NA-19", f"""WITH {CNT}, {COOC}, e AS (SELECT doc_id, count(*) AS n_edges FROM cooc GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_nodes FROM cnt GROUP BY 1)
SELECT doc_id, n_nodes, coalesce(n_edges, 0) AS n_edges,
round(coalesce(n_edges, 0) / greatest(n_nodes * (n_nodes - 1) / 2, 1), 6) AS density FROM n LEFT JOIN e USING (doc_id)""")
def _(spark, d):
    t = docs(spark, d)
    return A.network_density(P.cooccurrence(t), T.word_counts(t)).withColumn("density", r("density"))
