"""IO, DF and Q: sources, dataflow patterns, payload contracts."""

from pyspark.sql import functions as F

from ..functions.text import sentence_array, whitespace_words
from ..operators import dataflow as D
from ..operators import quality as Q
from ..operators import wordcount as W
from ..plans.tables import spread, table
from ..sources import events as E
from ..sources import store as S
from .base import docs, query, r
from .words import SPLIT, sql_reducer


def conv(spark, d):
    return table(spark, d, "conversations")


def events(spark, d):
    return table(spark, d, "events")


# ---------------------------------------------------------------- sources and sinks
@query("IO-01", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    path = S.shared_folder(spark, "events")
    events(spark, d).select("event_id", "user_id", "event_type", "value").write.json(path)
    return E.read_events(spark, path, "event_id long, user_id long, event_type string, value double")


@query("IO-02", """SELECT c.conv_id, c.turn, coalesce(CASE WHEN role = 'user' THEN c.text END, dd.text) AS text
FROM conversations c LEFT JOIN documents dd ON dd.doc_id = CASE WHEN role = 'user' THEN NULL ELSE c.conv_id END""")
def _(spark, d):
    user = F.col("role") == "user"
    refs = conv(spark, d).select("conv_id", "turn", F.when(user, F.col("text")).alias("inline"),
                                 F.when(~user, F.col("conv_id")).alias("pointer"))
    path = S.shared_folder(spark, "texts")
    named = docs(spark, d).join(refs.select(F.col("pointer").alias("doc_id")).distinct(), "doc_id", "left_semi")
    E.write_texts(named, path, "doc_id", "text")
    texts = E.read_texts(spark, path).withColumn("pointer", F.col("pointer").cast("long"))
    return E.resolve_text(refs, texts).select("conv_id", "turn", "text")


@query("IO-03", f"WITH {SPLIT} SELECT DISTINCT {sql_reducer('word', 3)} AS reducer FROM w")
def _(spark, d):
    return S.list_partitions(spark.read.parquet(_store(spark, d))).select(F.col("reducer").cast("long").alias("reducer"))


def _store(spark, d):
    path = S.shared_folder(spark, "words")
    S.write_partitioned(W.word_count(docs(spark, d)), path, 3)
    return path


@query("IO-04", f"""WITH {SPLIT} SELECT {sql_reducer('word', 3)} AS reducer, count(*) AS n_words, sum(n)::BIGINT AS n
FROM (SELECT word, count(*) AS n FROM w GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    stored = spark.read.parquet(_store(spark, d))
    return stored.groupBy(F.col("reducer").cast("long").alias("reducer")).agg(
        F.count("*").alias("n_words"), F.sum("n").alias("n"))


@query("IO-05", f"""WITH {SPLIT} SELECT word, n FROM (SELECT word, count(*) AS n FROM w GROUP BY 1)
WHERE {sql_reducer('word', 3)} = 1""")
def _(spark, d):
    return S.read_partition(spark, _store(spark, d), 1).select("word", "n")


@query("IO-06", """SELECT conv_id, count(*) AS n_texts, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def _(spark, d):
    path = S.shared_folder(spark, "posts")
    posts = D.gather(conv(spark, d), ["conv_id"], "turn", "role").withColumnRenamed("values", "roles")
    S.publish_posts(posts, path)
    back = spark.read.parquet(path)
    return back.groupBy("conv_id").agg(
        F.sum(F.size("roles")).alias("n_texts"),
        F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "roles"))),
                                           lambda s: s["roles"])), ",").alias("roles"))


@query("IO-07", """SELECT '{"user_id":' || user_id || ',"event_type":"' || event_type || '","n":' || count(*) || '}' AS value
FROM events GROUP BY user_id, event_type""")
def _(spark, d):
    return S.to_messages(events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")))


@query("IO-09", """SELECT 'orders' AS workflow, event_type AS config, count(*) AS runs, round(sum(value), 4) AS total FROM events GROUP BY 2""")
def _(spark, d):
    path = S.shared_folder(spark, "runs")
    ev = events(spark, d).select("event_id", "value", "event_type")
    S.write_runs(ev, path, F.lit("orders"), F.col("event_type"))
    return S.read_runs(spark, path, "event_id long, value double").groupBy("workflow", "config").agg(
        F.count("*").alias("runs"), r(F.sum("value"), 4).alias("total"))


@query("IO-10", """WITH a AS (SELECT user_id AS scenario, count(*) AS runs, sum(value) AS t, max(value) AS m FROM events
WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, count(*), sum(value), max(value) FROM events
WHERE event_type = 'view' GROUP BY 1)
SELECT scenario, sum(runs)::BIGINT AS runs, round(sum(t), 4) AS total_ms, max(m) AS max_ms FROM a GROUP BY 1""")
def _(spark, d):
    def one(kind):
        return events(spark, d).where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("scenario")).agg(
            F.count("*").alias("runs"), F.sum("value").alias("total_ms"), F.max("value").alias("max_ms"))

    return S.combine_runs("scenario", one("click"), one("view")).withColumn("total_ms", r("total_ms", 4))


_VALUE = "'{\"turn\":' || turn || ',\"role\":\"' || role || '\",\"chars\":' || length(text) || '}'"


@query("IO-11", f"""WITH v AS (SELECT conv_id, turn, role, {_VALUE} AS value FROM conversations)
SELECT conv_id, turn, value, CASE role WHEN 'user' THEN 's' || conv_id WHEN 'assistant' THEN 'e' || conv_id || '-' || turn
ELSE md5(value) END AS session FROM v""")
def _(spark, d):
    value = F.to_json(F.struct("turn", "role", F.length("text").alias("chars")))
    c = conv(spark, d).withColumn("v", value)
    enveloped = F.concat(F.lit('{"Data":{"Source":"http","Value":'), "v", F.lit('},"Session":"s'), F.col("conv_id"), F.lit('"}'))
    bus = F.concat(F.lit('{"source":"app","detail-type":"turn","detail":'), "v", F.lit(',"id":"e'), F.col("conv_id"),
                   F.lit("-"), F.col("turn"), F.lit('"}'))
    json = F.when(F.col("role") == "user", enveloped).when(F.col("role") == "assistant", bus).otherwise(F.col("v"))
    return E.normalise_envelope(c.select("conv_id", "turn", json.alias("json")))


# ---------------------------------------------------------------- patterns
@query("DF-01", """SELECT conv_id, turn, length(lower(trim(text)))::INT AS n, length(text) > 100 AS long_text FROM conversations""")
def _(spark, d):
    return D.chain(
        conv(spark, d),
        lambda x: x.withColumn("t", F.lower(F.trim("text"))),
        lambda x: x.withColumn("n", F.length("t")),
        lambda x: x.select("conv_id", "turn", "n", (F.length("text") > 100).alias("long_text")))


@query("DF-02", """SELECT conv_id, turn, len(l)::INT AS size, unnest(l) AS value, (generate_subscripts(l, 1) - 1)::INT AS "index" FROM (
SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS l FROM conversations)""")
def _(spark, d):
    return D.fan_out_map(conv(spark, d), whitespace_words(F.col("text")), ["conv_id", "turn"])


@query("DF-03", """SELECT event_id, b.branch, b."index"::INT AS "index", 3 AS size, CASE b."index" WHEN 0 THEN value * 2 WHEN 1 THEN value + 100
ELSE floor(value) END AS value FROM events, (VALUES ('double', 0), ('shift', 1), ('floor', 2)) b(branch, "index")""")
def _(spark, d):
    v = F.col("value")
    return D.fan_out(events(spark, d), {"double": v * 2, "shift": v + 100, "floor": F.floor(v).cast("double")}, ["event_id"])


def _branches(spark, d):
    c = conv(spark, d)

    def one(role, name):
        return c.where(F.col("role") == role).groupBy("conv_id").agg(F.count("*").alias(f"n_{name}"),
                                                                    F.max("turn").alias(f"last_{name}"))
    return {"user": one("user", "user"), "assistant": one("assistant", "assistant"), "system": one("system", "system")}


@query("DF-04", """WITH u AS (SELECT conv_id, count(*) AS n_user, max(turn) AS last_user FROM conversations WHERE role = 'user' GROUP BY 1),
a AS (SELECT conv_id, count(*) AS n_assistant, max(turn) AS last_assistant FROM conversations WHERE role = 'assistant' GROUP BY 1),
s AS (SELECT conv_id, count(*) AS n_system, max(turn) AS last_system FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT conv_id, n_user, last_user, n_assistant, last_assistant, coalesce(n_system, 0) AS n_system, coalesce(last_system, 0) AS last_system FROM u JOIN a USING (conv_id)
LEFT JOIN s USING (conv_id)""")
def _(spark, d):
    return D.fan_in(_branches(spark, d), "conv_id", ["system"]).fillna(0)


@query("DF-05", """SELECT conv_id, 0::BIGINT AS chunk, count(*) AS n, string_agg(role, '|' ORDER BY turn, role) AS "values" FROM conversations GROUP BY 1""")
def _(spark, d):
    g = D.gather(conv(spark, d), ["conv_id"], "turn", "role")
    return g.select("conv_id", "chunk", F.size("values").cast("long").alias("n"), F.array_join("values", "|").alias("values"))


@query("DF-06", """SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_ready, max(l_linenumber)::INT AS size FROM lineitem GROUP BY 1
HAVING count(DISTINCT l_linenumber) = max(l_linenumber)""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("size"))
    return D.complete_sessions(li, "l_orderkey", "l_linenumber", "size")


@query("DF-07", """SELECT * FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_value
FROM conversations) WHERE next_value IS NOT NULL""")
def _(spark, d):
    return D.pairwise(conv(spark, d), ["conv_id"], "turn", "role")


@query("DF-08", """SELECT event_id, value * 0.5 AS out, 'high' AS path FROM events WHERE value > 50
UNION ALL SELECT event_id, value * 3, 'low' FROM events WHERE NOT coalesce(value > 50, FALSE)""")
def _(spark, d):
    e = events(spark, d).select("event_id", "value")
    return D.branch_if(e, F.col("value") > 50,
                       lambda x: x.select("event_id", (F.col("value") * 0.5).alias("out"), F.lit("high").alias("path")),
                       lambda x: x.select("event_id", (F.col("value") * 3).alias("out"), F.lit("low").alias("path")))


@query("DF-09", """SELECT conv_id, turn, role, size FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations)
WHERE turn > 0 AND turn < size - 1""")
def _(spark, d):
    return D.where_index(conv(spark, d), "conv_id", "turn", "turn > 0 AND turn < size - 1").select("conv_id", "turn", "role", "size")


NESTED = """nst AS (SELECT conv_id, turn, i1, unnest(w) AS value, (generate_subscripts(w, 1) - 1)::INT AS i0 FROM (
 SELECT conv_id, turn, i1, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS w FROM (
 SELECT conv_id, turn, unnest(l) AS s, (generate_subscripts(l, 1) - 1)::INT AS i1 FROM (
 SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(30) || '\\2', 'g'),
   chr(30)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10) AS l FROM conversations))))"""


def _nested(spark, d):
    return D.nested_map(conv(spark, d), sentence_array(F.col("text")), whitespace_words, ["conv_id", "turn"])


@query("DF-10", f"WITH {NESTED} SELECT conv_id, turn, i1, i0, value FROM nst")
def _(spark, d):
    return _nested(spark, d)


@query("DF-11", f"""WITH {NESTED} SELECT conv_id, turn, i1, (i0 // 1000)::BIGINT AS chunk, string_agg(value, ' ' ORDER BY i0) AS "values"
FROM nst GROUP BY ALL""")
def _(spark, d):
    return D.pop_level(_nested(spark, d), ["conv_id", "turn", "i1"]).withColumn("values", F.array_join("values", " "))


@query("DF-12", """SELECT event_id, CASE WHEN value > 100 THEN 'large' WHEN value > 50 AND event_type = 'click' THEN 'click_mid'
WHEN value > 50 THEN 'mid' ELSE 'small' END AS class FROM events""")
def _(spark, d):
    v = F.col("value")
    rules = [(v > 100, F.lit("large")), ((v > 50) & (F.col("event_type") == "click"), F.lit("click_mid")), (v > 50, F.lit("mid"))]
    return events(spark, d).select("event_id", D.case_branch(rules, F.lit("small")).alias("class"))


@query("DF-13", """SELECT event_id, (value + 1) * 2 - value / 4 AS arith, (value > 10 AND NOT event_type = 'view') OR user_id <= 3 AS flag,
user_id % 7 AS rest FROM events WHERE value >= 5 AND value <= 200 AND event_type <> 'error'""")
def _(spark, d):
    return events(spark, d).where(F.expr("value >= 5 AND value <= 200 AND event_type != 'error'")).select(
        "event_id", F.expr("(value + 1) * 2 - value / 4").alias("arith"),
        F.expr("(value > 10 AND NOT event_type = 'view') OR user_id <= 3").alias("flag"), F.expr("user_id % 7").alias("rest"))


@query("DF-14", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squares,
len(embedding)::INT AS n FROM embeddings""")
def _(spark, d):
    sq = D.map_array(F.col("embedding"), lambda x: x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select(
        "vec_id", r(F.aggregate(sq, F.lit(0.0), lambda a, x: a + x)).alias("squares"), F.size("embedding").alias("n"))


@query("DF-15", """SELECT o_orderkey, o_orderstatus <> 'F' AS ok, coalesce(n_items, 0) AS n_items, round(amount, 4) AS amount FROM orders LEFT JOIN (
SELECT l_orderkey, count(*) AS n_items, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1) s
ON s.l_orderkey = o_orderkey AND o_orderstatus <> 'F'""")
def _(spark, d):
    fast = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "F").alias("ok"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    out = D.short_circuit(fast, li, lambda x: x.groupBy("o_orderkey").agg(
        F.count("*").alias("n_items"), F.sum("l_extendedprice").alias("amount")), "o_orderkey", "ok")
    return out.withColumn("amount", r("amount", 4)).fillna(0, ["n_items"])


@query("DF-16", """SELECT user_id, event_type AS branch, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
ORDER BY ts, event_type, event_id) AS k FROM events) WHERE k = 1""")
def _(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "branch")
    return D.first_completed(e, "user_id", "ts", "branch", ["event_id", "value"]).drop("ts")


_ROLES = ["system", "user", "assistant"]


@query("DF-17", """WITH e AS (SELECT DISTINCT conv_id, b.i, b.role FROM conversations, (VALUES (0, 'system'), (1, 'user'), (2, 'assistant')) b(i, role)),
dn AS (SELECT DISTINCT conv_id, role, TRUE AS ok FROM conversations)
SELECT conv_id, coalesce(string_agg(role, ',' ORDER BY i) FILTER (WHERE ok), '') AS ready,
coalesce(string_agg(role, ',' ORDER BY i) FILTER (WHERE ok IS NULL), '') AS missing FROM e LEFT JOIN dn USING (conv_id, role) GROUP BY 1""")
def _(spark, d):
    c = conv(spark, d).select("conv_id", "role")
    out = D.readiness(c, "conv_id", _ROLES, c, "role")
    return out.select("conv_id", F.array_join("ready", ",").alias("ready"), F.array_join("missing", ",").alias("missing"))


@query("DF-18", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (
PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return D.dedupe_results(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_shipdate")


@query("DF-19", """SELECT 'ok' AS outcome, count(*) AS n, round(sum(value / k), 4) AS total FROM (SELECT value,
(props->>'$.k')::BIGINT % 10 AS k FROM events) WHERE k <> 0 HAVING count(*) > 0
UNION ALL SELECT 'error', count(*), NULL FROM (SELECT (props->>'$.k')::BIGINT % 10 AS k FROM events) WHERE k = 0 HAVING count(*) > 0""")
def _(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long") % 10
    ok, errors = D.split_errors(events(spark, d).withColumn("k", k), F.try_divide("value", "k"))
    return ok.groupBy(F.lit("ok").alias("outcome")).agg(F.count("*").alias("n"), r(F.sum("result"), 4).alias("total")).unionByName(
        errors.groupBy(F.lit("error").alias("outcome")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total")))


@query("DF-20", """SELECT conv_id, coalesce(sys, '(none)') AS sys, coalesce(ask, '(none)') AS ask, sys IS NOT NULL AS sys_ready,
ask IS NOT NULL AS ask_ready FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS sys,
arg_min(text, turn) FILTER (WHERE role = 'user') AS ask FROM conversations GROUP BY 1)""")
def _(spark, d):
    def first(role):
        return F.min_by("text", F.when(F.col("role") == role, F.col("turn")))

    wide = conv(spark, d).groupBy("conv_id").agg(first("system").alias("sys"), first("user").alias("ask"))
    return D.with_fallback(wide, {"sys": "(none)", "ask": "(none)"})


@query("DF-21", """SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2""")
def _(spark, d):
    return D.merge_maps(conv(spark, d), ["conv_id"], "role", "turn", "text")


@query("DF-22", """SELECT user_id, max(score) AS score FROM (SELECT user_id, round(sum(value), 4) AS score FROM events
WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id, event_type) GROUP BY 1 ORDER BY score DESC, user_id LIMIT 20""")
def _(spark, d):
    def search(kind):
        return events(spark, d).where(F.col("event_type") == kind).groupBy("user_id").agg(r(F.sum("value"), 4).alias("score"))

    return D.merge_dedupe_rank([search(k) for k in ("click", "view", "purchase")], "user_id", "score", 20)


@query("DF-23", """SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return D.enrich(table(spark, d, "customer"), [(nation, "c_nationkey"), (region, "n_regionkey")]).select(
        "c_custkey", "c_mktsegment", "n_name", "r_name")


_CONTRACT = {"k": "integer", "label": "string", "user": "number"}


@query("Q-02", """WITH p AS (SELECT json_object('k', CASE WHEN event_type = 'error' THEN NULL ELSE (props->>'$.k')::BIGINT END) AS j,
event_type, user_id, (props->>'$.k')::BIGINT AS k FROM events)
SELECT 'k' AS field, 'integer' AS type, count(*) FILTER (WHERE event_type <> 'error') AS n_ok,
 0::BIGINT AS n_missing, count(*) FILTER (WHERE event_type = 'error') AS n_mismatched FROM p
UNION ALL SELECT 'label', 'string', count(*) FILTER (WHERE event_type IN ('click', 'view')),
 count(*) FILTER (WHERE event_type NOT IN ('click', 'view')), 0::BIGINT FROM p
UNION ALL SELECT 'user', 'number', count(*) FILTER (WHERE event_type <> 'signup'), 0::BIGINT,
 count(*) FILTER (WHERE event_type = 'signup') FROM p""")
def _(spark, d):
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    json = F.concat(
        F.lit('{"k":'), F.when(t == "error", F.concat(F.lit('"x'), k, F.lit('"'))).otherwise(k),
        F.when(t.isin("click", "view"), F.concat(F.lit(',"label":"'), t, F.lit('"'))).otherwise(""),
        F.lit(',"user":'), F.when(t == "signup", "true").otherwise(F.col("user_id").cast("string")), F.lit("}"))
    return Q.validate_payloads(events(spark, d).select(json.alias("json")), "json", _CONTRACT)
