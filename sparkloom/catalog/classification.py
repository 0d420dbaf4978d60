"""NC and NS: sentiment, terms, topics, features, summaries."""

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.draws import sql_normal, sql_uniform
from ..operators import analysis as A
from ..operators import classify as C
from ..operators import clusters as K
from ..operators import phrases as P
from ..operators import summary as S
from ..operators import tokens as T
from .base import CNT, docs, query, r, sql_list, texts
from .entities import (CTX, PMI, READ, SIM, TOPPOS, bags, ents, sents, sql_rich, sql_tag_grams, tags)

# ---------------------------------------------------------------- sentiment
SENTI = CTX + ",\n" + "bag AS (SELECT doc_id, entity, " + ", ".join(
    f"sum(CASE WHEN word IN {sql_list(ws)} THEN n ELSE 0 END)::BIGINT AS {k}" for k, ws in L.SENTIMENT.items()
) + """, sum(n)::BIGINT AS context_size FROM ctx GROUP BY ALL),
senti AS (SELECT *, (positive - negative) AS net,
   (positive - negative) * (1 + 0.5 * intensifier) * CASE WHEN negator > 0 THEN -1.0 ELSE 1.0 END AS adjusted,
   (positive - negative) / greatest(context_size, 1) AS polarity FROM (
   SELECT doc_id, entity, type, text, mentions, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative,
     coalesce(intensifier, 0) AS intensifier, coalesce(negator, 0) AS negator, coalesce(context_size, 0) AS context_size
   FROM uent LEFT JOIN bag USING (doc_id, entity)))"""
INTER = SENTI + "," + SIM + """,
sa AS (SELECT DISTINCT doc_id, entity, adjusted FROM senti),
inter AS (SELECT * FROM (SELECT sim.doc_id, entity_a, entity_b, cosine, a.adjusted + b.adjusted AS combined,
   CASE WHEN (a.adjusted >= 0) = (b.adjusted >= 0) THEN 1 ELSE -1 END AS agreement,
   row_number() OVER (PARTITION BY sim.doc_id ORDER BY cosine DESC, entity_a, entity_b) AS k
   FROM sim JOIN sa a ON a.doc_id = sim.doc_id AND a.entity = entity_a
   JOIN sa b ON b.doc_id = sim.doc_id AND b.entity = entity_b) WHERE k <= 50)"""


def senti(spark, d):
    b = bags(spark, d)
    return C.entity_sentiment(A.unique_entities(ents(spark, d)), A.entity_contexts(b, 30))


def inter(spark, d):
    return C.sentiment_interactions(A.entity_similarity(bags(spark, d), 100), senti(spark, d), 50)


@query("NC-01", f"""WITH {SENTI} SELECT doc_id, entity, type, text, positive, negative, intensifier, negator, context_size,
net, round(adjusted, 6) AS adjusted, round(polarity, 6) AS polarity FROM senti""")
def _(spark, d):
    return senti(spark, d).select(
        "doc_id", "entity", "type", "text", "positive", "negative", "intensifier", "negator", "context_size", "net",
        r("adjusted").alias("adjusted"), r("polarity").alias("polarity"))


@query("NC-02", f"""WITH {INTER} SELECT doc_id, entity_a, entity_b, cosine, round(combined, 6) AS combined,
agreement::INT AS agreement FROM inter""")
def _(spark, d):
    return inter(spark, d).select("doc_id", "entity_a", "entity_b", "cosine", r("combined").alias("combined"), "agreement")


@query("NC-03", f"""WITH {SENTI} SELECT doc_id, type, count(*) FILTER (WHERE net > 0) AS pos,
count(*) FILTER (WHERE net < 0) AS neg, count(*) FILTER (WHERE net = 0) AS neutral,
round(sum(adjusted), 6) AS total_adjusted FROM senti GROUP BY 1, 2""")
def _(spark, d):
    return C.sentiment_by_type(senti(spark, d)).withColumn("total_adjusted", r("total_adjusted"))


@query("NC-03-profile", f"""WITH {SENTI}, p AS (SELECT doc_id, count(*) AS n_entities,
count(*) FILTER (WHERE net <> 0) / count(*) AS subjectivity,
coalesce(sum(mentions) FILTER (WHERE type = 'TECH'), 0) / count(*) AS tech_ratio,
coalesce(sum(mentions) FILTER (WHERE type = 'PERSON'), 0) / count(*) AS person_ratio,
count(*) FILTER (WHERE net > 0) AS positive, count(*) FILTER (WHERE net < 0) AS negative FROM senti GROUP BY 1)
SELECT doc_id, n_entities, round(subjectivity, 6) AS subjectivity, round(tech_ratio, 6) AS tech_ratio,
round(person_ratio, 6) AS person_ratio, positive, negative, CASE WHEN positive > negative THEN 'positive'
WHEN negative > positive THEN 'negative' ELSE 'neutral' END AS overall FROM p""")
def _(spark, d):
    p = C.sentiment_profile(senti(spark, d))
    for c in ("subjectivity", "tech_ratio", "person_ratio"):
        p = p.withColumn(c, r(c))
    return p


# ---------------------------------------------------------------- terms
_W = "CASE tag " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in L.TAG_WEIGHTS.items()) + " ELSE 1.0 END"
TERMS = TOPPOS + f""",
tot AS (SELECT doc_id, count(*) AS total FROM tag GROUP BY 1),
terms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY score DESC, tag) AS kk FROM (
   SELECT doc_id, word, tag, freq, freq / total AS tf, round(freq / total * {_W}, 9) AS score
   FROM tpos JOIN tot USING (doc_id))) WHERE kk = 1),
top_terms AS (SELECT * EXCLUDE (rk), rk AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rk
   FROM terms) WHERE rk <= 100)"""


def terms(spark, d):
    tg = tags(spark, d)
    return C.pos_tfidf(A.top_per_pos(tg, 20).drop("rnk"), tg.groupBy("doc_id").agg(F.count("*").alias("total")))


@query("NC-04", f"""WITH {TERMS} SELECT doc_id, word, tag, freq, round(tf, 6) AS tf, round(score, 6) AS score, rnk::INT AS rnk
FROM top_terms""")
def _(spark, d):
    t = C.top_terms(terms(spark, d), 100)
    return t.withColumn("tf", r("tf")).withColumn("score", r("score"))


@query("NC-04-norm", f"""WITH {TERMS} SELECT doc_id, count(*) AS dim, round(sqrt(sum(score * score)), 6) AS norm
FROM terms GROUP BY 1""")
def _(spark, d):
    return C.term_norm(terms(spark, d)).withColumn("norm", r("norm"))


@query("NC-04b", f"""WITH {CNT}, df AS (SELECT word, count(*) AS df FROM cnt GROUP BY 1),
n AS (SELECT count(DISTINCT doc_id) AS n FROM cnt)
SELECT doc_id, word, round(freq / sum(freq) OVER (PARTITION BY doc_id), 6) AS tf, round(ln(n / df), 6) AS idf,
round(freq / sum(freq) OVER (PARTITION BY doc_id) * ln(n / df), 6) AS tfidf FROM cnt JOIN df USING (word), n""")
def _(spark, d):
    t = C.tfidf(T.word_counts(docs(spark, d)))
    return t.select("doc_id", "word", r("tf").alias("tf"), r("idf").alias("idf"), r("tfidf").alias("tfidf"))


TCOS = TERMS + """,
tk AS (SELECT t.doc_id, t.pos, lower(t.token) AS word FROM tok t JOIN top_terms w
   ON w.doc_id = t.doc_id AND w.word = lower(t.token)),
co AS (SELECT a.doc_id, a.word AS term, b.word AS ctx, count(*) * CASE WHEN a.word = b.word THEN 1 ELSE 1 END AS n
   FROM (SELECT *, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS s FROM tk) a JOIN tk b
   ON a.doc_id = b.doc_id AND b.pos = a.pos + a.s GROUP BY 1, 2, 3),
con AS (SELECT *, CASE WHEN term = ctx THEN n ELSE 2 * n END AS c FROM co),
cn AS (SELECT doc_id, term, ctx, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, term)) AS x FROM con)"""
TSIM = TCOS + """,
tsim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, term_a, term_b) AS k FROM (
   SELECT a.doc_id, a.term AS term_a, b.term AS term_b, round(sum(a.x * b.x), 6) AS cosine FROM cn a JOIN cn b
   ON a.doc_id = b.doc_id AND a.ctx = b.ctx AND a.term < b.term GROUP BY 1, 2, 3) WHERE cosine > 0.1) WHERE k <= 100)"""


def cooc(spark, d):
    return C.term_cooccurrence(T.tokens(docs(spark, d)), C.top_terms(terms(spark, d), 100))


def tsim(spark, d):
    return C.term_similarity(cooc(spark, d))


@query("NC-05", f"WITH {TSIM} SELECT doc_id, term_a, term_b, cosine FROM tsim")
def _(spark, d):
    return tsim(spark, d)


@query("NC-06", f"""WITH {TOPPOS}, {sql_tag_grams('b', 2, 50)},
p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM b)
SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def _(spark, d):
    return C.transition_entropy(A.pos_ngrams(docs(spark, d), 2, 50)).withColumn("entropy", r("entropy"))


# ---------------------------------------------------------------- topics
_TOPIC_ROWS = ", ".join(f"('{t}', '{w}', {len(ws)})" for t, ws in L.TOPICS.items() for w in ws)
TOPIC = PMI + f""",
cw AS (SELECT doc_id, word, sum(freq)::BIGINT AS weight FROM (
   SELECT doc_id, unnest([w1, w2]) AS word, freq FROM vn UNION ALL
   SELECT doc_id, unnest([split_part(gram, ' ', 1), split_part(gram, ' ', 3)]), freq FROM pp UNION ALL
   SELECT doc_id, unnest([w1, w2]), freq FROM pmi) GROUP BY ALL),
kw AS (SELECT * FROM (VALUES {_TOPIC_ROWS}) k(topic, word, n_keys)),
cwt AS (SELECT doc_id, sum(weight) AS total FROM cw GROUP BY 1),
tsc AS (SELECT c.doc_id, t.topic, coalesce(score, 0)::BIGINT AS score, coalesce(matched, 0)::BIGINT AS matched,
   coalesce(matched, 0) / t.n_keys AS coverage, coalesce(score, 0) / greatest(c.total, 1) AS normalized
   FROM cwt c CROSS JOIN (SELECT DISTINCT topic, n_keys FROM kw) t
   LEFT JOIN (SELECT doc_id, topic, sum(weight) AS score, count(*) AS matched FROM cw JOIN kw USING (word) GROUP BY ALL) s
   ON s.doc_id = c.doc_id AND s.topic = t.topic)"""


def topics(spark, d):
    return P.topic_scores(docs(spark, d))


@query("NC-07", f"""WITH {TOPIC} SELECT doc_id, topic, score, matched, round(coverage, 6) AS coverage,
round(normalized, 6) AS normalized FROM tsc""")
def _(spark, d):
    return topics(spark, d).withColumn("coverage", r("coverage")).withColumn("normalized", r("normalized"))


@query("NC-07-primary", f"""WITH {TOPIC} SELECT doc_id, topic, score, round(normalized, 6) AS normalized FROM (
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS k FROM tsc) WHERE k = 1""")
def _(spark, d):
    return C.primary_topic(topics(spark, d)).withColumn("normalized", r("normalized"))


def _sql_rank(rounds):
    out = PMI + """,
nb AS MATERIALIZED (SELECT doc_id, w1 AS src, w2 AS dst FROM pmi UNION ALL SELECT doc_id, w2, w1 FROM pmi),
dg AS MATERIALIZED (SELECT doc_id, src, count(*) AS deg FROM nb GROUP BY ALL),
nn AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM dg GROUP BY 1),
ed AS MATERIALIZED (SELECT nb.doc_id, nb.src, nb.dst, deg, n FROM nb JOIN dg USING (doc_id, src) JOIN nn USING (doc_id)),
r0 AS (SELECT doc_id, src AS word, 1.0 / n AS rank FROM dg JOIN nn USING (doc_id))"""
    for i in range(1, rounds + 1):
        out += f""",
r{i} AS MATERIALIZED (SELECT e.doc_id, e.dst AS word, (1 - 0.85::DOUBLE) / any_value(e.n) + 0.85::DOUBLE * sum(p.rank / e.deg) AS rank
  FROM ed e JOIN r{i - 1} p ON p.doc_id = e.doc_id AND p.word = e.src GROUP BY 1, 2)"""
    return out


@query("NC-08", f"WITH {_sql_rank(30)} SELECT doc_id, word, round(rank, 8) AS rank FROM r30")
def _(spark, d):
    return P.phrase_pagerank(docs(spark, d), 30).withColumn("rank", r("rank", 8))


@query("NC-08-topics", f"WITH {_sql_rank(30)} SELECT doc_id, " + ", ".join(
    f"round(coalesce(sum(rank) FILTER (WHERE word IN {sql_list(ws)}), 0), 8) AS {t}" for t, ws in L.TOPICS.items()
) + " FROM r30 GROUP BY 1")
def _(spark, d):
    t = C.topic_pagerank(P.phrase_pagerank(docs(spark, d), 30))
    return t.select("doc_id", *[r(c, 8).alias(c) for c in L.TOPICS])


# ---------------------------------------------------------------- features
GENRE = CNT + "," + sql_rich("rich") + """,
ft AS (SELECT *, 1 - simpson AS lexical_richness, least(avg_word_length / 10, 1.0) AS word_complexity,
  least(brunet_w / 100, 1.0) AS vocabulary_growth,
  least(greatest(avg_word_length / 8 * 0.4 + (1 - simpson) * 0.3 + ttr * 0.3, 0.0), 1.0) AS formality,
  CASE WHEN ttr > 0.6 AND avg_word_length > 5 THEN 'academic' WHEN ttr > 0.5 AND avg_word_length > 4.5 THEN 'technical'
   WHEN ttr > 0.4 THEN 'journalistic' ELSE 'conversational' END AS genre FROM rich)"""


def features(spark, d):
    return C.genre(A.lexical_richness(T.word_counts(docs(spark, d))))


@query("NC-09", f"""WITH {GENRE} SELECT doc_id, genre, round(formality, 6) AS formality, round(lexical_richness, 6) AS lexical_richness,
round(word_complexity, 6) AS word_complexity, round(vocabulary_growth, 6) AS vocabulary_growth FROM ft""")
def _(spark, d):
    return features(spark, d).select("doc_id", "genre", *[r(c).alias(c) for c in (
        "formality", "lexical_richness", "word_complexity", "vocabulary_growth")])


REPS = 200
_KEY = "doc_id || ':' || rep || ':' || i"
BOOT = CNT + f""",
zf AS (SELECT doc_id, list(freq ORDER BY rnk) AS f FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, word) AS rnk
   FROM cnt) WHERE rnk <= 50 GROUP BY 1),
dr AS (SELECT doc_id, rep, f[(floor(({sql_uniform('42', _KEY)} * len(f)) % len(f)) + 1)::INT] AS x FROM (
   SELECT doc_id, f, rep, unnest(range(len(f))) AS i FROM zf, range(1, {REPS + 1}) t(rep))),
st AS (SELECT doc_id, rep, count(DISTINCT x) / greatest(sum(x), 1) AS ttr,
   count(*) FILTER (WHERE x = 1) / count(DISTINCT x) AS hapax_ratio,
   sum(x * (x - 1)) / greatest(sum(x) * (sum(x) - 1), 1) AS simpson FROM dr GROUP BY 1, 2),
ci AS (SELECT doc_id, """ + ", ".join(
    f"avg({c}) AS {c}_mean, list_sort(list({c}))[{int(REPS * 0.025) + 1}] AS {c}_lower, "
    f"list_sort(list({c}))[{int(REPS * 0.975) + 1}] AS {c}_upper" for c in ("ttr", "hapax_ratio", "simpson")
) + " FROM st GROUP BY 1)"
CI_COLS = [f"{c}_{s}" for c in ("ttr", "hapax_ratio", "simpson") for s in ("mean", "lower", "upper")]


def intervals(spark, d):
    return C.spectrum_bootstrap(T.zipf(T.word_counts(docs(spark, d)), 50), REPS)


@query("NC-10", f"WITH {BOOT} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in CI_COLS)} FROM ci")
def _(spark, d):
    return intervals(spark, d).select("doc_id", *[r(c).alias(c) for c in CI_COLS])


LEVEL = READ + """,
lv AS (SELECT *, CASE WHEN fk_grade <= 6 THEN 'elementary' WHEN fk_grade <= 9 THEN 'middle_school'
  WHEN fk_grade <= 12 THEN 'high_school' WHEN fk_grade <= 16 THEN 'undergraduate' ELSE 'graduate' END AS level,
  least(1.0, fk_grade / 20 * 0.4 + avg_syllables / 3 * 0.3 + std_sentence_length / 15 * 0.3) AS complexity,
  CASE WHEN std_sentence_length > 0 THEN 1 - exp(-std_sentence_length / 5) ELSE 0 END AS variety FROM rdx)"""


def level(spark, d):
    return C.reading_level(A.readability(texts(spark, d)))


@query("NC-11", f"WITH {LEVEL} SELECT doc_id, level, round(complexity, 6) AS complexity, round(variety, 6) AS variety FROM lv")
def _(spark, d):
    return level(spark, d).select("doc_id", "level", r("complexity").alias("complexity"), r("variety").alias("variety"))


@query("NC-12")
def _(spark, d):
    return C.sentence_clusters(sents(spark, d), 5, 20)


@query("NC-12-documents")
def _(spark, d):
    """Clusters of every document's own sentences."""
    return K.sentence_clusters(sents(spark, d)).withColumn("intra_distance", r("intra_distance"))


@query("NS-10-documents")
def _(spark, d):
    """Whether every document's sentence clusters are tighter than shuffles of their labels."""
    t = K.cluster_significance(sents(spark, d))
    return t.select("doc_id", *[r(c).alias(c) for c in ("observed_intra", "perm_mean", "p_value")], "significant", "permutations")


# ---------------------------------------------------------------- summaries
def _sql_eigen(rounds):
    out = INTER + """,
ie AS MATERIALIZED (SELECT doc_id, entity_a AS src, entity_b AS dst, abs(combined) * cosine AS w FROM inter
   UNION ALL SELECT doc_id, entity_b, entity_a, abs(combined) * cosine FROM inter),
c0 AS (SELECT doc_id, src AS entity, 1.0 / count(*) OVER (PARTITION BY doc_id) AS c FROM (SELECT DISTINCT doc_id, src FROM ie))"""
    for i in range(1, rounds + 1):
        out += f""",
x{i} AS (SELECT ie.doc_id, dst AS entity, sum(w * c) AS c FROM ie JOIN c{i - 1} p ON p.doc_id = ie.doc_id AND p.entity = ie.src
   GROUP BY 1, 2),
c{i} AS MATERIALIZED (SELECT doc_id, entity, CASE WHEN nn > 0 THEN c / nn ELSE c END AS c FROM (
   SELECT *, sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS nn FROM x{i}))"""
    return out


def centrality(spark, d):
    return S.group_eigen_centrality(S.interaction_edges(inter(spark, d)), 30)


@query("NS-01", f"WITH {_sql_eigen(30)} SELECT doc_id, entity, round(c, 6) AS centrality FROM c30")
def _(spark, d):
    return centrality(spark, d).withColumn("centrality", r("centrality"))


@query("NS-02", f"""WITH {_sql_eigen(30)}, im AS (SELECT s.doc_id, s.entity, s.type, coalesce(c, 0) AS c,
round(coalesce(c, 0) * 10 + CASE WHEN type = 'TECH' THEN 3.0 WHEN type IN ('PERSON', 'ORG') THEN 2.0 ELSE 1.0 END +
CASE WHEN net <> 0 THEN abs(adjusted) * 0.5 ELSE 0 END, 6) AS importance FROM senti s LEFT JOIN c30
ON c30.doc_id = s.doc_id AND c30.entity = s.entity)
SELECT doc_id, entity, type, importance, round(c, 6) AS centrality, rnk::INT AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
ORDER BY importance DESC, entity, type) AS rnk FROM im) WHERE rnk <= 30""")
def _(spark, d):
    k = S.key_entities(senti(spark, d), centrality(spark, d), 30)
    return k.select("doc_id", "entity", "type", "importance", r("centrality").alias("centrality"), "rnk")


@query("NS-03", f"""WITH {TERMS} SELECT doc_id, word, tag, freq, score, k::INT AS rnk FROM (SELECT *, row_number() OVER (
PARTITION BY doc_id ORDER BY score DESC, word) AS k FROM top_terms WHERE tag IN {sql_list(L.KEYWORD_TAGS)} AND score > 0)
WHERE k <= 50""")
def _(spark, d):
    return S.keywords(C.top_terms(terms(spark, d), 100), 50).select("doc_id", "word", "tag", "freq", "score", "rnk")


def _sql_em(rounds):
    ts = list(L.TOPICS)
    out = _sql_rank(30) + """,
top50 AS (SELECT doc_id, word, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(rank, 9) DESC, word) AS k
  FROM r30) WHERE k <= 50),
wt AS MATERIALIZED (SELECT doc_id, p.word, rank, t.topic, CASE WHEN k.word IS NULL THEN 0.1 ELSE 2.0 END AS base
  FROM top50 p CROSS JOIN (SELECT DISTINCT topic FROM (VALUES """ + _TOPIC_ROWS + """) v(topic, word, n)) t
  LEFT JOIN (VALUES """ + _TOPIC_ROWS + """) k(topic, word, n) ON k.topic = t.topic AND k.word = p.word),
a0 AS (SELECT DISTINCT doc_id, topic, 1.0 / """ + str(len(ts)) + """ AS aff FROM wt)"""
    for i in range(1, rounds + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT doc_id, topic, m / sum(m) OVER (PARTITION BY doc_id) AS aff FROM (
  SELECT doc_id, topic, sum(rank * q) AS m FROM (SELECT wt.doc_id, wt.topic, wt.rank,
   base * aff / sum(base * aff) OVER (PARTITION BY wt.doc_id, wt.word) AS q FROM wt JOIN a{i - 1} a
   ON a.doc_id = wt.doc_id AND a.topic = wt.topic) GROUP BY 1, 2))"""
    return out


@query("NS-05", f"WITH {_sql_em(10)} SELECT doc_id, topic, round(aff, 6) AS affinity FROM a10")
def _(spark, d):
    e = S.topic_em(P.phrase_pagerank(docs(spark, d), 30, top=50), 10, None)
    return e.withColumn("affinity", r("affinity"))


@query("NS-06", f"""WITH {TOPIC}, sg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS k FROM tsc
WHERE normalized > 0.05)
SELECT t.doc_id, count(sg.topic) AS n_significant, round(coalesce(sum(sg.normalized) FILTER (WHERE k > 1), 0), 6) AS interdisciplinarity
FROM (SELECT DISTINCT doc_id FROM tsc) t LEFT JOIN sg USING (doc_id) GROUP BY 1""")
def _(spark, d):
    return S.topic_profile(topics(spark, d)).withColumn("interdisciplinarity", r("interdisciplinarity"))


_FLOORS = " OR ".join(f"(genre = '{g}' AND formality >= {a} AND ttr >= {b} AND word_complexity >= {c})"
                      for g, (a, b, c) in L.GENRE_FLOORS.items())


@query("NS-07", f"""WITH {GENRE} SELECT doc_id, round((lexical_richness * 0.4 + word_complexity * 0.6 + ttr + formality +
least(honore_r / 2000, 1.0) + least(word_entropy / 12, 1.0)) / 5, 6) AS overall_quality, ({_FLOORS}) AS meets_floors FROM ft""")
def _(spark, d):
    return S.quality_profile(features(spark, d)).select("doc_id", r("overall_quality").alias("overall_quality"), "meets_floors")


DRAWS = 500


def _n(tag_):
    return sql_normal("quality", f"'{tag_}:' || doc_id || ':' || i")


@query("NS-08", f"""WITH {BOOT},{GENRE.replace(CNT, '').lstrip(',')},
q AS (SELECT doc_id, greatest(0, ttr_mean + CASE WHEN ttr_upper > ttr_lower THEN (ttr_upper - ttr_lower) / 4 ELSE 0.01 END * {_n('t')}) * 0.3
 + (1 - greatest(0, simpson_mean + CASE WHEN simpson_upper > simpson_lower THEN (simpson_upper - simpson_lower) / 4 ELSE 0.001 END * {_n('s')})) * 0.3
 + greatest(0, formality + 0.05 * {_n('f')}) * 0.2 + word_complexity * 0.2 AS q
 FROM (SELECT ci.*, formality, word_complexity, unnest(range(1, {DRAWS + 1})) AS i FROM ci JOIN ft USING (doc_id)))
SELECT doc_id, round(avg(q), 6) AS mean, round(list_sort(list(q))[{DRAWS // 2 + 1}], 6) AS median,
 round(list_sort(list(q))[{int(DRAWS * 0.05) + 1}], 6) AS p5, round(list_sort(list(q))[{int(DRAWS * 0.95) + 1}], 6) AS p95,
 round(stddev_pop(q), 6) AS std FROM q GROUP BY 1""")
def _(spark, d):
    m = S.mc_quality(features(spark, d), intervals(spark, d), DRAWS)
    return m.select("doc_id", *[r(c).alias(c) for c in ("mean", "median", "p5", "p95", "std")])


_AUD = "CASE level " + " ".join(f"WHEN '{k}' THEN '{a}'" for k, (a, _) in L.AUDIENCES.items()) + " ELSE 'specialist' END"
_SIM = "level IN " + sql_list(k for k, (_, s) in L.AUDIENCES.items() if s)


@query("NS-09", f"""WITH {LEVEL} SELECT doc_id, level, {_AUD} AS audience, {_SIM} AS simplify,
CASE WHEN variety > 0.7 AND avg_sentence_length > 15 THEN 'complex_varied' WHEN variety > 0.5 THEN 'balanced'
WHEN avg_sentence_length > 20 THEN 'dense' ELSE 'simple' END AS style FROM lv""")
def _(spark, d):
    return S.audience(level(spark, d)).select("doc_id", "level", "audience", "simplify", "style")
