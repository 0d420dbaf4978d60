"""Secret scan: fixed patterns, and corpus-wide ownership frequency for token-like strings.

Everything is SQL functions.  ``split`` and ``regexp_extract_all`` see the same leftmost matches, so the lengths
of the pieces between matches and of the matches themselves give every span in code points.

The method: every mixed token-like string and every base match is hashed, and the hashes are aggregated by
distinct repository and distinct owner over the corpus.  A string that several owners hold, or one owner in many
repositories, is a copied example; one that a single owner holds in few repositories looks live.  Token-like strings
that look live are added as spans of kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import keep

#: Base kinds with pattern, group whose length counts and its least length.
BASE_KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: Token-like strings of the method: 20 characters or more of a base64 alphabet.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

SPAN = "struct<kind:string,start:bigint,end:bigint,hash:string>"


def _spans(text: Column, kind: str, pattern: str, value_group: int, least: int, mixed: bool = False) -> Column:
    """Spans of one kind: matches in order, with running lengths of the pieces before them."""
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    walked = F.aggregate(
        F.arrays_zip(pieces.alias("gap"), whole.alias("match"), value.alias("value")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, x: _step(acc, x, kind, least, mixed), lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(f"array<{SPAN}>"))


def _step(acc: Column, x: Column, kind: str, least: int, mixed: bool) -> Column:
    start = acc["at"] + x["gap"]
    end = start + F.coalesce(F.length(x["match"]), F.lit(0))
    good = F.length(x["value"]) >= least
    if mixed:
        good = good & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]")
    span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.sha2(x["value"], 256).alias("hash"))
    return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))


def candidates(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, owner, repository[, text], base, tokens): spans of the base kinds and of the method, with value hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[_spans(text, *kind) for kind in BASE_KINDS])
    more = ["text"] if keep_text else []
    return docs.select("doc_id", "owner", "repository", *more, base.alias("base"),
                       _spans(text, "owned", TOKEN, 0, 20, mixed=True).alias("tokens"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of every candidate; distinct counts in two map-side-combined steps."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "tokens")).alias("s")).select("s.hash", "owner", "repository")
    pairs = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_live_owners: int = 1,
         max_live_repositories: int = 10, keep_text: bool = False) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``, spans ordered by start, then kind as listed.

    Each span is (start, rank, kind, end, n_owners, n_repositories, verdict); the verdict is ``live`` for a
    value that at most ``max_live_owners`` owners hold in at most ``max_live_repositories`` repositories, and
    ``example`` for a copied one: a template that one owner spread over thousands is one.  Base spans always stay;
    ``owned`` spans are kept when live and not inside a base span.  Null text is empty; null owners count as one
    owner; repeated rows are judged each; other columns are ignored.  ``keep_text`` adds the text of the row.
    """
    rows = docs.select("doc_id", F.col("text"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    found = keep(candidates(rows, keep_text).withColumn("row", F.monotonically_increasing_id()), "secrets")
    counts = ownership(found)
    ranks = {kind: i for i, (kind, *_) in enumerate(BASE_KINDS)} | {"owned": len(BASE_KINDS)}
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    fresh = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    each = found.select("row", F.explode(F.concat("base", fresh)).alias("s")).select("row", "s.*")
    judged = each.join(counts, "hash").withColumn(
        "verdict", F.when((F.col("n_owners") <= max_live_owners) & (F.col("n_repositories") <= max_live_repositories), "live").otherwise("example"))
    judged = judged.where((F.col("kind") != "owned") | (F.col("verdict") == "live"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", rank[F.col("kind")].alias("rank"), "kind", "end", "n_owners", "n_repositories", "verdict"))).alias("spans"))
    more = ["text"] if keep_text else []
    return found.select("row", "doc_id", *more).join(spans, "row", "left").select(
        "doc_id", *more, F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mask: str = "[secret]") -> DataFrame:
    """(doc_id, text) of every row of ``docs`` with every base or live span replaced; overlapping spans become one.

    Each row is cut at the spans of its own text: rows that share an id, repeated rows and rows with a null id come
    back each.  Null text becomes empty.
    """
    judged = scan(docs, owner, repository, keep_text=True)
    merged = F.aggregate(
        "spans", F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["done"], F.when(s["start"] >= acc["at"], F.concat(
                F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise("")).alias("done"),
            s["end"].alias("at"))),
        lambda acc: F.concat(acc["done"], F.substr("text", acc["at"] + 1)))
    return judged.withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", merged.alias("text"))
