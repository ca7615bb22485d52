"""Quality rules with host-level verdicts.

Document rules look at words (`[^\\x20\\x09-\\x0D]+`), symbols, repeated lines and repeated 8-word windows. A document
fails its base rules with fewer than 20 words, or where repeated windows hold more than 30 % of its words.

Host rules: failures are counted per host; a beta prior is fitted to the hosts' rates by the method of moments, and a
host's rate is shrunk to (failures + alpha) / (documents + alpha + beta). Documents of a host whose shrunk rate is over
`host_limit` are not kept. A host is one row however many documents it has: counts are summed before the shuffle, and
verdicts are joined back by host (a hot host is split by skew handling or the verdicts are broadcast by size).

Repeated windows: each 8-word window becomes a 64-bit hash, kept in the text's own array. Where a text has as many
distinct hashes as windows nothing repeats; otherwise (hash, position) pairs are sorted, and the windows whose hash
stands beside an equal one cover their words; the union's length is the sum of min(8, distance to the next).
Two different windows of a text of w windows share a hash with a probability below w * w / 2**65. Everything stays in
Spark's expressions; no text is split over rows and no text is shuffled. The rules' narrow columns are written to the
shared folder once, and read for the hosts' counts and for the verdicts.

Defined cases: a null text has no words and fails; a null host is a host of its own (its rows join by null-safe
equality); repeated rows count each; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixgrid.llm.session import cut

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
HOST_LIMIT = 0.5


def base_rules(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    lines = F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    counted = own.select(
        "id", "host", words.alias("words"), lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = counted.select(
        "id", "host", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"case when size(words) > {WINDOW} then transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) else array() end").alias("hashes"),
    )
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ranked = hashed.withColumn("ranked", F.when(some, F.expr("sort_array(transform(hashes, (h, i) -> struct(h as h, i as i)))")).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))).drop("hashes")
    twice = ranked.withColumn("at", F.expr("sort_array(transform(filter(ranked, (x, j) -> (j > 0 and x.h = ranked[j - 1].h) or (j + 1 < size(ranked) and x.h = ranked[j + 1].h)), x -> x.i))")).drop("ranked")
    covered = F.expr(f"case when size(at) = 0 then 0L else aggregate(transform(at, (p, j) -> case when j + 1 < size(at) then least({WINDOW}, at[j + 1] - p) else {WINDOW} end), 0L, (s, x) -> s + x) end")
    out = twice.withColumn("n_repeat_words", covered).drop("at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, host_rate: the rate shrunk by the beta prior that fits the hosts' rates."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"))
    # without spread between hosts, or with more than a beta has, the prior is one document's worth of the mean
    strength = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(1.0)
    prior = moments.select((F.col("m") * strength).alias("alpha"), strength.alias("weight"))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("weight"))).alias("host_rate"))  # one row


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Columns: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, kept."""
    judged = cut(base_rules(docs, id_col, text_col, host_col))  # nine narrow columns: texts are read once
    verdicts = host_rates(judged).select(F.col("host").alias("judged_host"), (F.col("host_rate") > host_limit).alias("host_failed"))
    joined = judged.join(verdicts, F.col("host").eqNullSafe(F.col("judged_host")))
    out = joined.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
    return out.withColumnRenamed("id", id_col)


ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS MATERIALIZED (SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
named AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM win),
twice AS (SELECT rid, i FROM named QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
covered AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
base AS MATERIALIZED (SELECT d.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid)),
judged AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
hosts AS MATERIALIZED (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source),
moments AS (SELECT avg(f / n) AS m, coalesce(var_samp(f / n), 0) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 1.0 END AS weight FROM moments),
verdicts AS (SELECT source, (f + m * weight) / (n + weight) > {HOST_LIMIT} AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""
