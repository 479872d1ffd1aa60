"""Merkle fixity audit of WARC records.

A record's bytes are a WARC response block; its digest is SHA-256 over header and payload. Records are leaves in archive order: the position of a record is the number that
the archive's manifest gives it, so a lost record shifts nothing. A node covers an ordered range of 256^h positions; its hash is SHA-256 over its children's
hashes in order, each after its place among the siblings. The tree goes on below a position by the digest's hex digits, so equal positions
and repeated records make no large group: a node has at most 256 children, a leaf holds digests and how often they occur. Above the lowest
node that holds all records there are only chains of only children, which are not built. Both replicas are built in one pass.

An audit compares the roots of two replicas and descends, level by level, only into nodes whose hashes differ. Records are read and hashed once; the audit reads
the table of their digests. What differs is located in the archive: the file of 65,536 positions that it is in, and the range of bytes there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, materialize, quoted, table

#: Hex digits of a node's address at each level, leaves first: position (17: a mark for null, then 16) and 4 of the digest; 2 digits a step.
LEAF, POSITION, STEP = 21, 17, 2
#: Positions in a file of the archive; a power of two.
FILE = 1 << 16
LEVELS = tuple(range(LEAF, 0, -STEP))  # 21, 19, ..., 1


def warc_block(uri: Column, payload: Column, record_type: str = "response") -> Column:
    """The bytes of a WARC/1.1 record. A null uri or payload is empty."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {record_type}\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def address(position: Column, digest: Column) -> Column:
    """Sorts as positions do, null first; then by digest."""
    place = F.when(position.isNull(), F.lit("0" * POSITION)).otherwise(F.concat(F.lit("1"), F.lpad(F.lower(F.hex(position.bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")))
    return F.concat(place, F.substring(digest, 1, LEAF - POSITION))


def _levels(records: DataFrame, keys: list[str], tag: str) -> list[DataFrame]:
    """Levels of the trees over records (keys, position, digest, bytes), one tree for each value of keys: (keys, node, hash, records, bytes)."""
    leaf = records.groupBy(*keys, address(F.col("position"), F.col("digest")).alias("node"), "digest").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))
    leaf = leaf.groupBy(*keys, "node").agg(F.sort_array(F.collect_list(F.struct("digest", "records"))).alias("d"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
    text = F.array_join(F.transform("d", lambda x: F.concat_ws(":", x["digest"], x["records"].cast("string"))), ",")
    levels = [materialize(leaf.select(*keys, "node", F.sha2(text, 256).alias("hash"), "records", "bytes"), tag)]
    for width in LEVELS[1:]:
        if _at_top(levels[-1]):
            break
        up = levels[-1].groupBy(*keys, F.substring("node", 1, width).alias("up")).agg(F.sort_array(F.collect_list(F.struct(F.substring("node", width + 1, STEP).alias("k"), "hash"))).alias("c"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
        joined = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["k"], x["hash"])), ",")
        levels.append(materialize(up.select(*keys, F.col("up").alias("node"), F.sha2(joined, 256).alias("hash"), "records", "bytes"), tag))
    return levels


def _at_top(level: DataFrame) -> bool:
    """Whether at most one node is left under each mark of null, so that all levels above are chains of only children."""
    mark = F.substring("node", 1, 1)
    ends = [f(F.when(mark == m, F.col("node"))) for m in "01" for f in (F.min, F.max)]
    a, b, c, d = level.agg(*ends).first()
    return a == b and c == d


def _lift(level: DataFrame, width: int) -> DataFrame:
    """The level above one of only children: each node's hash is over that of its one child. No shuffle."""
    up = F.sha2(F.concat_ws(":", F.substring("node", width + 1, STEP), F.col("hash")), 256)
    return level.select(F.substring("node", 1, width).alias("node"), up.alias("hash"), "records", "bytes")


def tree(records: DataFrame, tag: str = "tree") -> list[DataFrame]:
    """Levels of the tree over records (position, digest, bytes), leaves first: (node, hash, records, bytes). The last level has one root
    for each mark of null, at the lowest node that holds all records; each level is written, so that an audit reads what it needs and no more."""
    return _levels(records, [], tag)


def audit(left: list[DataFrame], right: list[DataFrame]) -> tuple[DataFrame, list[int]]:
    """The leaves at which two trees differ, as (node, left_hash, right_hash), and how many nodes were compared at each level, from the top.
    A tree that has its roots lower than the other is lifted to that height."""
    left, right = list(left), list(right)
    for low, high in ((left, right), (right, left)):
        while len(low) < len(high):
            low.append(_lift(low[-1], LEVELS[len(low)]))
    compared, bad = [], None
    for a, b in zip(reversed(left), reversed(right), strict=True):
        sides = a.select("node", F.col("hash").alias("l"), F.lit(None).cast("string").alias("r")).unionByName(b.select("node", F.lit(None).cast("string").alias("l"), F.col("hash").alias("r")))
        if bad is not None:
            sides = sides.withColumn("up", F.expr(f"substring(node, 1, length(node) - {STEP})")).join(bad, "up", "left_semi")
        both = materialize(sides.groupBy("node").agg(F.max("l").alias("left_hash"), F.max("r").alias("right_hash")), "audit")
        unlike = ~F.col("left_hash").eqNullSafe(F.col("right_hash"))
        n, n_bad = both.agg(F.count("*"), F.count_if(unlike)).first()
        compared.append(n)
        differing = both.where(unlike)
        bad = differing.select(F.col("node").alias("up"))
        if not n_bad:
            break
    return differing, compared


def ranges(records: DataFrame) -> DataFrame:
    """(position, warc_file, range_offset, range_length): where an archive has each position, from its records (position, digest, bytes). A file holds the records of
    FILE positions in order, all records of a position side by side; a null position is a file of its own. Records of one position are summed before the window,
    which therefore never sees more than FILE rows."""
    at = records.groupBy("position").agg(F.sum("bytes").alias("range_length")).withColumn("warc_file", F.shiftright("position", FILE.bit_length() - 1))
    before = F.sum("range_length").over(W.partitionBy("warc_file").orderBy("position").rowsBetween(W.unboundedPreceding, 0)) - F.col("range_length")
    return at.select("position", "warc_file", before.alias("range_offset"), "range_length")


def fixity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records that two replicas (position, digest, bytes) do not share: (position, status, left_digest, right_digest, copies, warc_file, range_offset, range_length).

    status: missing (left alone has it), extra (right alone), corrupt (a position whose one record differs), count (the same record, another
    number of times). Only the digests of records under differing leaves are read again. Equal or empty replicas give no rows; a null position is a place of
    its own; a position with several records gives a row for each that is not shared. The range is that of the position in left's archive; null if left lacks it.
    """
    records = materialize(left.select("position", "digest", "bytes", F.lit(0).alias("side")).unionByName(right.select("position", "digest", "bytes", F.lit(1).alias("side"))), "records")
    levels = _levels(records, ["side"], "tree")
    bad, _ = audit(*([x.where(F.col("side") == n).drop("side") for x in levels] for n in (0, 1)))
    sides = []
    for n, name in enumerate(("left", "right")):
        own = records.where(F.col("side") == n).withColumn("node", address(F.col("position"), F.col("digest"))).join(bad.select("node"), "node", "left_semi")
        sides.append(own.groupBy("position", "digest").agg(F.count("*").alias(name)))
    both = sides[0].join(sides[1].withColumnsRenamed({"position": "p", "digest": "d"}), F.col("position").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "full")
    both = both.select(F.coalesce("position", "p").alias("position"), F.coalesce("digest", "d").alias("digest"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right")).where("left <> right")
    both = materialize(both, "differences")
    discard(*levels)
    one = both.groupBy("position").agg(F.count("*").alias("n"), F.sum("left").alias("l"), F.sum("right").alias("r"), F.min(F.when(F.col("left") > 0, F.col("digest"))).alias("left_digest"), F.min(F.when(F.col("right") > 0, F.col("digest"))).alias("right_digest"))
    swapped = one.where("n = 2 and l = 1 and r = 1 and left_digest is not null and right_digest is not null")
    rows = both.join(swapped.select(F.col("position").alias("p")), F.col("position").eqNullSafe(F.col("p")), "left_anti")
    status = F.when(F.col("right") == 0, "missing").when(F.col("left") == 0, "extra").otherwise("count")
    rows = rows.select("position", status.alias("status"), F.when(F.col("left") > 0, F.col("digest")).alias("left_digest"), F.when(F.col("right") > 0, F.col("digest")).alias("right_digest"), F.abs(F.col("left") - F.col("right")).alias("copies"))
    found = swapped.select("position", F.lit("corrupt").alias("status"), "left_digest", "right_digest", F.lit(1).cast("long").alias("copies")).unionByName(rows)
    # Only files with damage are laid out.
    file = F.shiftright("position", FILE.bit_length() - 1)
    hurt = both.select(file.alias("f")).distinct()
    where = ranges(records.where("side = 0").join(hurt, file.eqNullSafe(F.col("f")), "left_semi")).withColumnRenamed("position", "p")
    out = materialize(found.join(where, F.col("position").eqNullSafe(F.col("p")), "left").drop("p"), "located")
    discard(records, both)
    return out


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(position, digest, bytes) of the WARC records of pages: one each, also for null urls and empty or null pages. Other columns take no part."""
    block = warc_block(quoted(url_col), quoted(html_col))
    return pages.select(quoted(id_col).cast("long").alias("position"), F.sha2(block, 256).alias("digest"), F.length(block).cast("long").alias("bytes"))


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: every 101st page has a byte more, every 211th is lost, every 307th is there twice."""
    hurt = pages.where("page_id is null or page_id % 211 <> 5").withColumn("html", F.when(F.col("page_id") % 101 == 3, F.concat(F.coalesce("html", F.lit("")), F.lit("\x01"))).otherwise(F.col("html")))
    return hurt.withColumn("times", F.explode(F.when(F.col("page_id") % 307 == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("times")


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits all pages against a replica with known damage; the rows are the damage."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity(archive(pages), archive(damaged(pages))).withColumnRenamed("position", "page_id")


ORACLE = """
WITH r AS (SELECT page_id, url, html, unnest(CASE WHEN page_id % 307 = 7 THEN [1, 2] ELSE [1] END) AS t FROM pages WHERE page_id IS NULL OR page_id % 211 <> 5),
b AS (SELECT page_id, url, CASE WHEN page_id % 101 = 3 THEN coalesce(html, '') || chr(1) ELSE html END AS html FROM r),
da AS (SELECT page_id, sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS d FROM pages),
db AS (SELECT page_id, sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS d FROM b),
c AS (SELECT page_id, d, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM (SELECT page_id, d, count(*) AS l FROM da GROUP BY ALL) FULL JOIN (SELECT page_id, d, count(*) AS r FROM db GROUP BY ALL) USING (page_id, d) WHERE coalesce(l, 0) <> coalesce(r, 0)),
p AS (SELECT *, count(*) OVER w = 2 AND sum(l) OVER w = 1 AND sum(r) OVER w = 1 AS swapped FROM c WINDOW w AS (PARTITION BY page_id)),
f AS (SELECT page_id, 'corrupt' AS status, max(CASE WHEN l > 0 THEN d END) AS left_digest, max(CASE WHEN r > 0 THEN d END) AS right_digest, 1::BIGINT AS copies FROM p WHERE swapped GROUP BY page_id
UNION ALL SELECT page_id, CASE WHEN r = 0 THEN 'missing' WHEN l = 0 THEN 'extra' ELSE 'count' END, CASE WHEN l > 0 THEN d END, CASE WHEN r > 0 THEN d END, abs(l - r)::BIGINT FROM p WHERE NOT swapped),
n AS (SELECT page_id, sum(strlen('WARC/1.1' || 'WARC-Type: response' || 'WARC-Target-URI: ' || coalesce(url, '') || 'Content-Length: ' || strlen(coalesce(html, '')) || coalesce(html, '')) + 14)::BIGINT AS b FROM pages GROUP BY page_id),
o AS (SELECT page_id, (page_id // 65536)::BIGINT AS warc_file, (sum(b) OVER (PARTITION BY page_id // 65536 ORDER BY page_id) - b)::BIGINT AS range_offset, b AS range_length FROM n)
SELECT f.*, o.warc_file, o.range_offset, o.range_length FROM f LEFT JOIN o ON f.page_id IS NOT DISTINCT FROM o.page_id
"""
