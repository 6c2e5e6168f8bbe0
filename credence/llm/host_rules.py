"""Quality rules on documents, and verdicts on their hosts, in DataFrame operations alone.

A document fails by its own words (too few, or too many of them in repeated windows).
Failures of any rule are then counted by host. A host's rate of failures is shrunk
towards the rate of all hosts with a beta prior whose strength is fitted to how much the
hosts' rates differ beyond chance, so a host with few documents isn't judged by one or
two. Documents of hosts whose shrunk rate exceeds the limit go, by a join back.

Windows of three words are told apart by their words; only windows whose 64-bit hash
another window of the document has are compared.

Defined results: null, empty and wordless texts have zero counts and fail; a null host
is a host of its own; repeated rows count each; texts may have any length; an empty
table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import SPACES, WORD, materialise

MIN_WORDS, MAX_REPEATED, MAX_SYMBOLS, MAX_DUP_LINES, MAX_RATE = 50, 50, 20, 30, 0.75
SYMBOLS = "[#*$%&|<>]"


def metrics(df: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"), F.split(t, "\n").alias("l"), F.regexp_count(t, F.lit(SYMBOLS)).alias("symbols"))
    rows = rows.withColumn("l", F.filter("l", lambda line: line.rlike(f"[^{SPACES}]"))).withColumn("n", F.size("w"))
    window = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]))
    rows = rows.select(
        "key", "host", "n", "symbols",
        F.length(F.array_join("w", "")).alias("chars"),
        F.size("l").alias("lines"), (F.size("l") - F.size(F.array_distinct("l"))).alias("dup_lines"),
        F.when(F.col("n") >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("h"), "w",
    )
    return rows.select(
        F.col("key").alias(key), F.col("host").alias(host),
        *(F.col(a).cast("long").alias(b) for a, b in (("n", "n_words"), ("chars", "word_chars"), ("symbols", "n_symbols"), ("lines", "n_lines"), ("dup_lines", "n_dup_lines"))),
        repeated_words(rows["h"], rows["w"]).alias("n_repeat_words"),
    )


def repeated_words(h: Column, w: Column) -> Column:
    """Number of words in windows of three that occur twice or more; ``h`` has the windows' hashes in order, ``w`` the words."""
    none = F.lit(0).cast("long")

    # Windows are sorted by hash, then place. Those whose hash a neighbour has are sorted by their words, and those with
    # an equal neighbour are repeated. Their places, sorted, cover three words each, fewer where the next one begins earlier.
    def same(s: Column, x: Column, k: Column, field: str) -> Column:
        return ((k > 0) & (F.get(s, k - 1)[field] == x[field])) | F.coalesce(F.get(s, k + 1)[field] == x[field], F.lit(False))

    def worded(s: Column) -> Column:
        met = F.filter(s, lambda x, k: same(s, x, k, "h"))
        words = lambda x: F.concat_ws(" ", F.get(w, x["i"]), F.get(w, x["i"] + 1), F.get(w, x["i"] + 2))
        return F.sort_array(F.transform(met, lambda x: F.struct(words(x).alias("t"), x["i"].alias("i"))))

    def places(s: Column) -> Column:
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(s, x, k, "t")), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(none.alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def within(value: Column, use) -> Column:
        """``use`` of a value that is computed once: it is bound by going through a list of one."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    several = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    counted = within(several, lambda s: within(worded(s), lambda t: covered(places(t))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(counted)


def failures(rows: DataFrame) -> DataFrame:
    """Adds base_failed, and failed: whether any rule fails."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    return rows.withColumn("base_failed", base).withColumn("failed", base | more)


def host_rates(rows: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, rejected) of every host; rate is the shrunk one."""
    hosts = rows.groupBy(host).agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"))
    p = F.col("n_failed") / F.col("n_docs")
    whole = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count("*").alias("hosts"), F.sum(F.col("n_docs") * p * p).alias("squares"))
    # Moments: the variance of the hosts' rates, less what chance alone gives, fixes the prior's strength (1 to 10,000 documents).
    mean = F.col("k") / F.col("n")
    spread = F.col("squares") / F.col("n") - mean * mean
    chance = mean * (1 - mean) * F.col("hosts") / F.col("n")
    beyond = spread - chance
    strength = F.when(beyond <= 0, F.lit(10000.0)).otherwise(F.least(F.lit(10000.0), F.greatest(F.lit(1.0), F.try_divide(mean * (1 - mean), beyond) - 1)))
    prior = whole.select(mean.alias("prior_mean"), strength.alias("prior_strength"))
    rated = hosts.crossJoin(F.broadcast(prior))  # one row
    rate = (F.col("n_failed") + F.col("prior_mean") * F.col("prior_strength")) / (F.col("n_docs") + F.col("prior_strength"))
    return rated.select(host, "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("rejected"))


def verdicts(df: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    rows = materialise(failures(metrics(df, text, key, host)), "host-rules")
    rejected = host_rates(rows, host, max_rate).where("rejected").select(F.col(host).alias("_host"), F.lit(True).alias("_gone"))
    judged = rows.join(rejected, F.col(host).eqNullSafe(F.col("_host")), "left")
    kept = ~F.col("base_failed") & F.col("_gone").isNull()
    return judged.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


#: The same rows by DuckDB.
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS l FROM t),
p AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, a, lead(a) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM p),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
e AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN e USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m),
a AS (SELECT *, base_failed OR 100 * n_symbols > {MAX_SYMBOLS} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines AS failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS k FROM a GROUP BY source),
s AS (SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 AS spread, count(*) / sum(n) AS share FROM h),
q AS (SELECT mean, CASE WHEN spread - mean * (1 - mean) * share <= 0 THEN 10000.0
             ELSE least(10000.0, greatest(1.0, mean * (1 - mean) / (spread - mean * (1 - mean) * share) - 1)) END AS strength FROM s),
x AS (SELECT source, (k + mean * strength) / (n + strength) > {MAX_RATE} AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM a LEFT JOIN x ON a.source IS NOT DISTINCT FROM x.source
"""
