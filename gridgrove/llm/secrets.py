"""Secret scans with corpus-wide ownership frequency, in SQL functions only.

Base spans are found by pattern. Candidate tokens, long runs of mixed letters and digits, are hashed, and for each hash the
distinct repositories (the source) and owners (the document) that hold it are counted over the corpus. A token of
one repository and at most OWNERS documents there is owner-specific and looks live: it is a span of
kind `live`. One that more repositories or documents hold is a copied example and adds no span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgrove.llm.common import checkpoint, read, table

# The base patterns, letters of `assign` in either case, written out so that no Unicode folding takes part.
_KEYWORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# A run of token characters; those with a digit and a letter and 20 characters or more are candidates.
RUN = "[A-Za-z0-9+/_-]{20,}"

KINDS = ("assign", "access", "hex", "live")
OWNERS = 3  # documents of one repository up to which a token is taken for owner-specific


def matches(text: Column, pattern: str, kind: int) -> Column:
    """array of (k, i, b, v): the leftmost non-overlapping matches in order, and the length of the piece before each."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(found, between, lambda v, b: F.struct(F.lit(kind).alias("k"), F.length(b).cast("bigint").alias("b"), v.alias("v"))), lambda m: m["v"].isNotNull())
    return F.transform(pairs, lambda m, i: F.struct(m["k"].alias("k"), i.alias("i"), m["b"].alias("b"), m["v"].alias("v")))


def placed(found: DataFrame) -> DataFrame:
    """(row, k, s, e, v, good, apart) of matches (row, k, i, b, v): offsets in code points, end exclusive.

    A match's end is the sum of the lengths up to it. good tells those of enough characters, or for candidates of letters and digits,
    and apart candidates that overlap with no base span: those that begin before a candidate's end must end by its begin.
    """
    to_here = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("e", F.sum(F.col("b") + F.length("v")).over(to_here)).withColumn("s", F.col("e") - F.length("v"))
    v = F.col("v")
    good = F.when(F.col("k") == 0, F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6).when(F.col("k") == 3, v.rlike("[0-9]") & v.rlike("[A-Za-z]")).otherwise(True)
    rows = rows.select("row", "k", "s", "e", "v", good.alias("good"))
    base = F.col("good") & (F.col("k") < 3)
    # candidates stand at their end, before base spans that begin there
    order = [F.when(F.col("k") < 3, F.col("s")).otherwise(F.col("e")), F.col("k") < 3, "s", "k"]
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("apart", F.coalesce(F.max(F.when(base, F.col("e"))).over(before), F.lit(0)) <= F.col("s"))


def ownership(found: DataFrame, repository: str, key: str, token: str) -> DataFrame:
    """(h, repositories, owners, n): how many distinct repositories and documents hold each hashed token, and how often it occurs.

    A token's documents are counted by its (token, repository, document) rows, summed before they meet, so that
    a token that many documents hold is never gathered in one row.
    """
    each = found.groupBy(F.col(token).alias("h"), F.col(repository).alias("r"), F.col(key).alias("d")).agg(F.count("*").alias("n"))
    each = each.groupBy("h", "r").agg(F.count("*").alias("owners"), F.sum("n").alias("n"))
    return each.groupBy("h").agg(F.count("*").alias("repositories"), F.sum("owners").alias("owners"), F.sum("n").alias("n"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "source", owners: int = OWNERS) -> DataFrame:
    """(id, spans, copied) of every row: its spans (s, k, e, v) by start, then kind, and how many candidates are copied examples.

    Null texts are empty; a null repository is one of its own, that of the empty name. Candidates that overlap with a base span add no span of
    their own, and count only as copied. Repeated rows are all returned, and an empty table gives none. Texts of any length are scanned whole: their matches,
    not the texts, are written to the shared folder, and each match is a row from there on, so that work is in proportion to them.
    Tokens that make up a ten-thousandth of all candidates, 10,000 at most, are judged by a broadcast of the same verdicts, so that one that
    is widely copied, or often repeated by its owner, is never gathered in one task.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(repository).alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = F.concat(*(matches(F.col("t"), p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, RUN))))
    rows = table(rows.select(F.monotonically_increasing_id().alias("row"), "id", "repository", found.alias("m")), "matches")
    some = rows.where(F.size("m") > 0)
    spans = table(placed(some.select("row", F.inline("m"))).withColumn("h", F.when(F.col("good") & (F.col("k") == 3), F.sha2("v", 256))), "spans")

    names = some.select("row", "id", F.coalesce(F.col("repository").cast("string"), F.lit("")).alias("r"))
    freq = checkpoint(ownership(spans.where("h is not null").select("row", "h").join(names, "row"), "r", "id", "h"))
    total = freq.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    owned = (F.col("repositories") == 1) & (F.col("owners") <= owners)
    hot = freq.where((F.col("n") > owners) & (F.col("n") * 10_000 >= total)).select("h", owned.alias("hot"))
    live = freq.where(owned).select("h", F.lit(True).alias("live"))
    marked = spans.join(F.broadcast(hot), "h", "left")
    # a key of its own for each row that isn't asked for, so that these don't meet
    asked = F.when(F.col("h").isNotNull() & F.col("hot").isNull(), F.col("h")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))
    marked = marked.withColumn("j", asked).join(live.withColumnRenamed("h", "j"), "j", "left").withColumn("live", F.coalesce("hot", "live", F.lit(False)))
    shown = F.col("good") & ((F.col("k") < 3) | (F.col("live") & F.col("apart")))
    span = F.struct(F.col("s").cast("int").alias("s"), "k", F.col("e").cast("int").alias("e"), "v")
    judged = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.when(shown, span))).alias("spans"), F.count(F.when(F.col("h").isNotNull() & ~F.col("live"), 1)).alias("copied"))
    judged = judged.join(some.select("row", "id"), "row").select("id", "spans", "copied")
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,v:string>>)")
    return judged.union(rows.where(F.size("m") == 0).select("id", none, F.lit(0).cast("bigint")))


def joined(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(kind, m["k"]), m["s"], m["e"])), ",")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    found = scan(read(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda m: m["k"] == k)).cast("bigint")

    return found.select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda m: m["k"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(3).alias("n_live"),
        F.col("copied").alias("n_copied"),
    )


_PATTERNS = ", ".join("({k}, '{p}')".format(k=k, p=p.replace("'", "''")) for k, p in enumerate((ASSIGN, ACCESS, HEX, RUN)))

SQL = f"""
WITH p(k, pattern) AS (VALUES {_PATTERNS}),
f AS (
  SELECT doc_id, source, k, pattern, regexp_extract_all(COALESCE(text, ''), pattern) AS found, string_split_regex(COALESCE(text, ''), pattern) AS pieces FROM documents, p
),
m AS (
  SELECT doc_id, source, k, pattern, UNNEST(found) AS v, UNNEST(pieces[:LEN(found)]) AS b, UNNEST(GENERATE_SERIES(1, LEN(found))) AS i FROM f WHERE LEN(found) > 0
),
o AS (
  SELECT *, CAST(SUM(LENGTH(b) + LENGTH(v)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS e FROM m
),
s AS (
  SELECT doc_id, source, k, v, e - LENGTH(v) AS s, e FROM o
  WHERE CASE k WHEN 0 THEN LENGTH(regexp_extract(v, pattern, 2)) >= 6 WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') ELSE TRUE END
),
own AS (SELECT v, COUNT(DISTINCT COALESCE(source, '')) AS repositories, COUNT(DISTINCT doc_id) AS owners FROM s WHERE k = 3 GROUP BY v),
j AS (
  SELECT s.*, CASE WHEN k < 3 THEN TRUE ELSE repositories = 1 AND owners <= {OWNERS} END AS live,
    k = 3 AND EXISTS (SELECT 1 FROM s b WHERE b.k < 3 AND b.doc_id = s.doc_id AND b.s < s.e AND s.s < b.e) AS within
  FROM s LEFT JOIN own ON s.v = own.v AND s.k = 3
),
t AS (SELECT *, (['assign', 'access', 'hex', 'live'])[k + 1] || ':' || s || ':' || e AS part FROM j),
g AS (
  SELECT doc_id, COUNT(*) FILTER (k = 0) AS n_assign, COUNT(*) FILTER (k = 1) AS n_access, COUNT(*) FILTER (k = 2) AS n_hex,
    STRING_AGG(part, ',' ORDER BY s, k) FILTER (k < 3) AS base, STRING_AGG(part, ',' ORDER BY s, k) FILTER (live AND NOT within) AS spans,
    COUNT(*) FILTER (k = 3 AND live AND NOT within) AS n_live, COUNT(*) FILTER (k = 3 AND NOT live) AS n_copied
  FROM t GROUP BY doc_id
)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
  SHA256(COALESCE(base, '')) AS base_sha256, COALESCE(g.spans, '') AS spans, COALESCE(n_live, 0) AS n_live, COALESCE(n_copied, 0) AS n_copied
FROM documents LEFT JOIN g USING (doc_id)
"""
