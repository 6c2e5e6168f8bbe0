"""A fixity audit of WARC archives by Merkle trees.

Pages become WARC response records; an archive holds the records of a span of ids, in the
order of their ids. A leaf is what a record is, not where it lies: its id and address, its
digest, and how many equal ones there are. Above the leaves, nodes hold ordered ranges of
ids, and with them ranges of offsets: one id's records (a 4,096th of them where an id has
very many), then 16, 256 and 4,096 ids. A node's hash is made of its children's hashes and
lengths, never of offsets, so a record that is lost, added or longer changes the nodes
above itself alone. Replicas are compared by their roots; only below nodes that differ
does the comparison go on, level by level, down to the records.

A record whose bytes differ is a leaf that only one replica has and another that only the
other has, both under one id and address: as many of these as pair up are corrupt, what is
left over is missing from the replica, or extra in it.

Defined results: a null page text counts as empty and a null address as no address; equal
records are counted, and each has a row of its own; records of one id come in the order of
their names (a hash of address and digest); a null id comes in an archive of its own;
texts may have any length; an empty table gives an empty audit; other columns aren't read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.llm.common import exclusive_offsets, materialise, release

#: Ids that an archive spans, and bits of a record's name that part the records of one id.
ARCHIVE, NAME_BITS = 4096, 12
#: Bits by which a node's place is shortened from level to level: 16, 256, 4,096 ids.
SHIFTS = (NAME_BITS + 4, 4, 4)
#: Stands for the null archive where rows are grouped and joined.
NOWHERE = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"
#: What ends a record.
END = "\r\n\r\n"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", span: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """(archive, key, url, payload): the bytes of a WARC/1.0 response record, an HTTP message, for each page."""
    body = F.coalesce(F.col(html), F.lit(""))
    address = F.coalesce(F.col(url), F.lit(""))
    name = F.md5(F.concat_ws("|", F.col(key).cast("string"), address))
    uuid = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    message = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    number = F.when(F.col(key).isNull(), F.lit("")).otherwise(F.concat(F.lit("\r\nX-Record-Key: "), F.col(key).cast("string")))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}"), number, F.lit("\r\nWARC-Target-URI: "), address,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(message).cast("string"), F.lit("\r\n\r\n"),
    )
    payload = F.concat(head, message, F.lit(END)).cast("binary")
    return pages.select(F.floor(F.col(key) / F.lit(span)).cast("long").alias("archive"), F.col(key).cast("long").alias("key"), address.alias("url"), payload.alias("payload"))


def write_warc(archives: DataFrame, path: str) -> None:
    """Files of records (text in UTF-8) below ``path``, a folder for each archive, records in the order of their ids."""
    text = F.decode("payload", "UTF-8")
    rows = archives.select("archive", "key", "url", F.substring(text, F.lit(1), F.length(text) - len(END)).alias("value"))
    ordered = rows.repartitionByRange("archive", "key", F.xxhash64("value")).sortWithinPartitions("archive", "key", "url")
    ordered.select("archive", "value").write.partitionBy("archive").option("lineSep", END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, key, url, payload) of the records in files below ``path``; a file is read by one task."""

    def run(batches):
        for batch in batches:
            for archive, content in zip(*(c.to_pylist() for c in batch.columns)):
                out, at = [], 0
                while at < len(content):
                    body = content.index(b"\r\n\r\n", at) + 4
                    lines = content[at:body].decode().split("\r\n")[1:]
                    head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines if line)}
                    end = body + int(head["content-length"]) + len(END)
                    key = head.get("x-record-key")
                    out.append((archive, int(key) if key else None, head.get("warc-target-uri", ""), content[at:end]))
                    at = end
                for i in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 256]), (pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["archive", "key", "url", "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    number = F.expr("try_cast(regexp_extract(path, 'archive=([^/]+)', 1) AS long)")
    return files.select(number, "content").mapInArrow(run, "archive long, key long, url string, payload binary")


def damaged(archives: DataFrame, every: int) -> DataFrame:
    """A replica in which every so-many-th record by id has another character in its middle."""
    text = F.decode("payload", "UTF-8")
    hurt = F.encode(F.overlay(text, F.lit("\x01"), (F.length(text) / 2).cast("int") + 1, F.lit(1)), "UTF-8")
    return archives.withColumn("payload", F.when(F.pmod("key", F.lit(every)) == 0, hurt).otherwise(F.col("payload")))


def harmed(archives: DataFrame, damage: int = 97, loss: int = 101, repeat: int = 103) -> DataFrame:
    """A replica with damaged, lost and repeated records: every so-many-th by id each."""
    left = damaged(archives, damage).where(~F.coalesce(F.pmod("key", F.lit(loss)) == 50, F.lit(False)))
    return left.withColumn("_copy", F.explode(F.when(F.pmod("key", F.lit(repeat)) == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy")


def leaves(archives: DataFrame) -> DataFrame:
    """(arc, place, name, key, url, length, digest, n, hash): distinct records; equal ones are counted before any row moves."""
    hashed = archives.select(F.coalesce("archive", F.lit(NOWHERE)).alias("arc"), "key", "url", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("digest"))
    counted = hashed.groupBy("arc", "key", "url", "length", "digest").agg(F.count("*").alias("n"))
    named = counted.withColumn("name", F.sha2(F.concat_ws("|", "url", "digest"), 256))
    slot = F.coalesce(F.pmod("key", F.lit(ARCHIVE)), F.lit(0))
    part = F.conv(F.substring("name", 1, NAME_BITS // 4), 16, 10).cast("long")
    return named.withColumn("place", F.shiftleft(slot, NAME_BITS) + part).withColumn("hash", F.sha2(F.concat_ws("|", "key", "length", "n", "name"), 256))


def level_above(nodes: DataFrame, shift: int, order: str) -> DataFrame:
    """(arc, place, n, length, hash) of the nodes over ranges of places, children in ``order``."""
    up = nodes.groupBy("arc", F.shiftright("place", shift).alias("parent"))
    kids = F.array_sort(F.collect_list(F.struct(order, "hash")))
    up = up.agg(F.sum("n").alias("n"), F.sum("length").alias("length"), kids.alias("kids"))
    joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
    return up.select("arc", F.col("parent").alias("place"), "n", "length", F.sha2(F.concat_ws("|", "n", "length", joined), 256).alias("hash"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """The levels of all archives' trees, from the records up to the roots."""
    levels = [leaf, materialise(level_above(leaf.withColumn("length", F.col("length") * F.col("n")), 0, "name"), "fixity-level")]
    for shift in SHIFTS:
        levels.append(materialise(level_above(levels[-1], shift, "place"), "fixity-level"))
    return levels


def differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """(arc, place) of nodes whose hashes differ or that only one side has."""
    both = one.select("arc", "place", F.col("hash").alias("one")).join(two.select("arc", "place", F.col("hash").alias("two")), ["arc", "place"], "full_outer")
    return both.where(~F.col("one").eqNullSafe(F.col("two"))).select("arc", "place")


def below(nodes: DataFrame, bad: DataFrame, shift: int) -> DataFrame:
    """The children of differing nodes."""
    wanted = bad.select("arc", F.col("place").alias("_p"))
    return nodes.withColumn("_p", F.shiftright("place", shift)).join(wanted, ["arc", "_p"], "left_semi").drop("_p")


LEAF = ["arc", "place", "name", "key", "url", "length", "digest"]


def locate(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """(leaf columns, here, there) of records that are not as often in both replicas, by descent from the roots."""
    bad = materialise(differing(one[-1], two[-1]), "fixity-bad")
    for a, b, shift in zip(one[-2:0:-1], two[-2:0:-1], SHIFTS[::-1]):
        before, bad = bad, materialise(differing(below(a, bad, shift), below(b, bad, shift)), "fixity-bad")
        release(before)
    sides = below(one[0], bad, 0).withColumn("_one", F.lit(True)).unionByName(below(two[0], bad, 0).withColumn("_one", F.lit(False)))
    count = lambda side: F.sum(F.when(side, F.col("n")).otherwise(F.lit(0))).alias
    found = sides.groupBy(*LEAF).agg(count(F.col("_one"))("here"), count(~F.col("_one"))("there")).where("here != there")
    return materialise(found, "fixity-leaves")


def paired(bad: DataFrame) -> DataFrame:
    """(leaf columns, ok, corrupt, missing, extra): what becomes of each leaf's records."""
    rest = bad.withColumn("_lost", F.greatest(F.col("here") - F.col("there"), F.lit(0))).withColumn("_new", F.greatest(F.col("there") - F.col("here"), F.lit(0)))
    rest = rest.withColumn("_id", F.sha2(F.concat_ws("|", "arc", F.coalesce(F.col("key").cast("string"), F.lit("-")), "url"), 256)).withColumn("_part", F.substring("name", 1, 3))
    pairs = rest.groupBy("_id").agg(F.least(F.sum("_lost"), F.sum("_new")).alias("_pairs"))
    placed = exclusive_offsets(exclusive_offsets(rest, "_id", "_part", ["name"], "_lost", "_lost_before"), "_id", "_part", ["name"], "_new", "_new_before").join(pairs, "_id")
    within = lambda n, before: F.greatest(F.least(F.col("_pairs") - F.col(before), F.col(n)), F.lit(0))
    placed = placed.withColumn("corrupt", within("_lost", "_lost_before")).withColumn("_taken", within("_new", "_new_before"))
    return placed.select(*LEAF, F.least("here", "there").alias("ok"), "corrupt", (F.col("_lost") - F.col("corrupt")).alias("missing"), (F.col("_new") - F.col("_taken")).alias("extra"))


def placed(levels: list[DataFrame]) -> DataFrame:
    """The leaves with ``at`` and ``begin``: records and bytes of the archive before them, by sums of nodes, then inside them."""
    node = Window.partitionBy("arc").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = levels[1].select("arc", "place", *(F.coalesce(F.sum(c).over(node), F.lit(0)).alias(f"_{c}") for c in ("n", "length")))
    inside = Window.partitionBy("arc", "place").orderBy("name", "key").rowsBetween(Window.unboundedPreceding, -1)
    sums = levels[0].withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("begin", F.coalesce(F.sum(F.col("n") * F.col("length")).over(inside), F.lit(0)))
    return sums.join(before, ["arc", "place"]).withColumn("at", F.col("at") + F.col("_n")).withColumn("begin", F.col("begin") + F.col("_length")).drop("_n", "_length")


def audit(master: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, archive, place, begin, length, digest, status) of every record of the master, and of extra ones of the replica."""
    one, two = (tree(materialise(leaves(r), "fixity-records")) for r in (master, replica))
    verdict = paired(locate(one, two)).select("arc", "place", "name", F.col("key").alias("_key"), "ok", "corrupt", "missing", "extra")
    number = F.coalesce("_key", F.lit(NOWHERE)) == F.coalesce("key", F.lit(NOWHERE))

    def rows(levels: list[DataFrame], how: str, parts: dict) -> DataFrame:
        v = verdict.withColumnsRenamed({"arc": "_arc", "place": "_place", "name": "_name"})
        met = placed(levels).join(v, (F.col("arc") == F.col("_arc")) & (F.col("place") == F.col("_place")) & (F.col("name") == F.col("_name")) & number, how)
        lists = [F.array_repeat(F.lit(status), n.cast("int")) for status, n in parts.items()]
        each = met.select("*", F.posexplode(F.concat(*lists)).alias("_i", "status"))
        archive = F.when(F.col("arc") != F.lit(NOWHERE), F.col("arc"))
        return each.select(F.col("key").alias("page_id"), archive.alias("archive"), (F.col("at") + F.col("_i")).alias("place"), (F.col("begin") + F.col("_i") * F.col("length")).alias("begin"), "length", "digest", "status")

    none = F.lit(0)
    known = rows(one, "left", {"ok": F.coalesce("ok", "n"), "corrupt": F.coalesce("corrupt", none), "missing": F.coalesce("missing", none)})
    extra = rows(two, "inner", {"extra": F.col("extra")})
    return known.unionByName(extra)


#: The same rows by DuckDB, for the query's replica: what becomes of a record follows from the digests that both sides have.
ORACLE = """
WITH n AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, md5(concat_ws('|', page_id::VARCHAR, url)) AS u, chr(13) || chr(10) AS nl FROM n),
h AS (SELECT *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html)::VARCHAR || nl || nl || html AS message FROM m),
p AS (SELECT page_id, url, 'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:uuid:'
       || concat_ws('-', u[1:8], u[9:12], u[13:16], u[17:20], u[21:32]) || '>' || nl || 'WARC-Date: 2024-01-01T00:00:00Z'
       || coalesce(nl || 'X-Record-Key: ' || page_id::VARCHAR, '') || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Type: application/http; msgtype=response'
       || nl || 'Content-Length: ' || strlen(message)::VARCHAR || nl || nl || message || nl || nl AS payload FROM h),
v AS (SELECT page_id, url, CASE WHEN page_id % 97 = 0 THEN substr(payload, 1, length(payload) // 2) || chr(1) || substr(payload, length(payload) // 2 + 2) ELSE payload END AS payload
      FROM p, range(2) AS c(i) WHERE coalesce(page_id % 101, 0) <> 50 AND (i = 0 OR page_id % 103 = 7)),
a AS (SELECT 1 AS side, page_id, url, strlen(payload)::BIGINT AS length, sha256(payload) AS digest, count(*) AS n FROM p GROUP BY ALL
      UNION ALL SELECT 2, page_id, url, strlen(payload)::BIGINT, sha256(payload), count(*) FROM v GROUP BY ALL),
b AS (SELECT *, floor(page_id / 4096.0)::BIGINT AS archive, sha256(url || '|' || digest) AS name,
      sum(CASE side WHEN 1 THEN n ELSE 0 END) OVER d AS here, sum(CASE side WHEN 2 THEN n ELSE 0 END) OVER d AS there FROM a WINDOW d AS (PARTITION BY page_id, url, digest)),
o AS (SELECT *, coalesce(sum(n) OVER w, 0) AS lie, coalesce(sum(n * length) OVER w, 0) AS off,
      CASE side WHEN 1 THEN greatest(here - there, 0) ELSE greatest(there - here, 0) END AS rest FROM b
      WINDOW w AS (PARTITION BY side, archive ORDER BY page_id, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, coalesce(sum(rest) OVER (PARTITION BY side, page_id, url ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      least(sum(CASE side WHEN 1 THEN rest ELSE 0 END) OVER k, sum(CASE side WHEN 2 THEN rest ELSE 0 END) OVER k) AS pairs FROM o WINDOW k AS (PARTITION BY page_id, url)),
e AS (SELECT *, unnest(range(CASE side WHEN 1 THEN n ELSE greatest(rest - greatest(least(pairs - before, rest), 0), 0) END::BIGINT)) AS i FROM g)
SELECT page_id, archive, (lie + i)::BIGINT AS place, (off + i * length)::BIGINT AS begin, length, digest,
       CASE WHEN side = 2 THEN 'extra' WHEN i < least(here, there) THEN 'ok' WHEN before + i - least(here, there) < pairs THEN 'corrupt' ELSE 'missing' END AS status FROM e
"""
