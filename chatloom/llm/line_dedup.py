"""Line dedup: a suffix array over line ids by prefix doubling finds repeated line runs; later copies are deleted.

DataFrame functions only. Lines get 64-bit ids; a line id that occurs once ends every repeat, so only stretches
of repeated lines ("segments") take part. Prefix doubling names the 2^k lines from each position: a name is the
place of the pair (name of the first half, name of the second half) in the global order of such pairs, so names sort
as the suffixes do to that depth. Two runs of n lines are equal if their first and their last 2^k lines (2^k <= n) have
equal names: they lie in one interval of the suffix array whose longest common prefix is at least n.

For a repeat to count it must hold min_words words. Any such run is covered by its shortest sub-runs of min_words
words, seen forwards from every line and backwards from every line, so those decide: a sub-run goes unless it is the
first of its interval (by doc_id, then row, then line). A copy that overlaps the first one in the same document stays.
As a sub-run has at most min_words lines, doubling ends at that depth, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, free_names, materialize, numbered, table, word_count


def line_positions(rows: DataFrame) -> DataFrame:
    """(rid, doc, line, h, words) of every line of rows (rid, doc, text) that has a word."""
    lines = rows.select("rid", "doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "s"))
    return lines.select("rid", "doc", "line", F.xxhash64("s").alias("h"), word_count(F.col("s")).alias("words")).where("words > 0")


def suffix_names(lines: DataFrame, min_words: int) -> tuple[DataFrame, int]:
    """Positions in repeated stretches with names n0, n1, ... of their first 1, 2, 4, ... lines, and the number of levels."""
    lines = materialize(lines, "lines")
    ids = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    ids = materialize(ids.select("h").repartitionByRange("h").sortWithinPartitions("h").select("h", F.monotonically_increasing_id().alias("n0")), "names")
    by_doc = W.partitionBy("rid").orderBy("line")
    p = lines.withColumn("pos", F.row_number().over(by_doc)).join(ids, "h").select("rid", "doc", "line", "pos", "words", "n0")
    p = p.withColumn("seg", F.col("pos") - F.row_number().over(by_doc))
    seg = W.partitionBy("rid", "seg").orderBy("pos")
    p = p.withColumn("after", F.sum("words").over(seg.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("words"))
    p = p.withColumn("total", F.sum("words").over(W.partitionBy("rid", "seg"))).where(F.col("total") >= min_words)
    p = p.withColumn("ahead", F.when(F.col("before") + min_words <= F.col("total"), F.count("*").over(W.partitionBy("rid", "seg").orderBy("before").rangeBetween(0, min_words - 1))))
    p = p.withColumn("back", F.when(F.col("after") >= min_words, F.count("*").over(W.partitionBy("rid", "seg").orderBy("after").rangeBetween(1 - min_words, 0))))
    p = materialize(p.drop("before", "after", "total"), "positions")
    deepest = p.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 1
    levels, trash = 1, [lines, ids]
    while 2**levels <= deepest:
        k = levels
        pair = p.withColumn("x", F.col(f"n{k - 1}")).withColumn("y", F.coalesce(F.lead(f"n{k - 1}", 2 ** (k - 1)).over(seg), F.lit(-1)))
        names = pair.groupBy("x", "y").agg(F.count("*").alias("c"))
        names = materialize(names.select("x", "y").repartitionByRange("x", "y").sortWithinPartitions("x", "y").select("x", "y", F.monotonically_increasing_id().alias(f"n{k}")), "names")
        trash += [p, names]
        p = materialize(pair.join(names, ["x", "y"]).drop("x", "y"), "positions")
        levels += 1
    discard(*trash)
    return p, levels


def later_copies(p: DataFrame, levels: int) -> DataFrame:
    """(rid, cut): by row, the stretches of lines to delete, as first and last line number, apart from one another."""
    runs = p.where("ahead is not null").select("rid", "doc", "pos", F.col("ahead").alias("n")).unionByName(p.where("back is not null").select("rid", "doc", (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("n"))).distinct()
    level = F.floor(F.log2("n")).cast("int")
    runs = runs.withColumn("k", level).withColumn("last", (F.col("pos") + F.col("n") - F.pow(F.lit(2), F.col("k"))).cast("long"))
    named = p.select("rid", "pos", F.array(*[f"n{k}" for k in range(levels)]).alias("names"))
    runs = runs.join(named, ["rid", "pos"]).withColumn("x", F.col("names")[F.col("k")]).drop("names")
    runs = runs.join(named.withColumnRenamed("pos", "last"), ["rid", "last"]).withColumn("y", F.col("names")[F.col("k")]).select("rid", "doc", "pos", "n", "x", "y")
    runs = materialize(runs, "runs")
    # Written, so that the join below is one of two plain shuffles, whose large parts Spark can split where a run is in very many documents.
    first = materialize(runs.groupBy("n", "x", "y").agg(F.min(F.struct("doc", "rid", "pos")).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c"), "first")
    gone = runs.join(first, ["n", "x", "y"]).where("(rid <> f.rid) or (pos >= f.pos + n)").select("rid", "pos", "n")
    gone = gone.groupBy("rid", "pos").agg(F.max("n").alias("n")).select("rid", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos")).distinct()
    gone = gone.join(p.select("rid", "pos", "line"), ["rid", "pos"])
    island = gone.withColumn("g", F.col("pos") - F.row_number().over(W.partitionBy("rid").orderBy("pos")))
    cut = island.groupBy("rid", "g").agg(F.min("line").alias("a"), F.max("line").alias("b")).drop("g")
    cut = materialize(cut.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("cut")), "cuts")
    discard(runs, first, p)
    return cut


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs with later copies of repeated line runs deleted from text_col, plus n_lines and n_removed (long).

    Lines end at \\n. Lines without a word take no part; they go with a run that encloses them. Null and empty texts
    have one empty line and lose nothing (null stays null). Rows with equal ids are different documents, the earlier
    row first; a null id sorts before all others. An emptied document stays, with an empty text. Other columns stay as they are, whatever
    their names; where docs has a column n_lines or n_removed, the new one gets an underscore. No rows give none.
    """
    rows = numbered(docs, doc=id_col, text=text_col)
    p, levels = suffix_names(line_positions(rows), min_words)
    joined = rows.join(later_copies(p, levels), "rid", "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    gone = F.coalesce(F.aggregate("cut", F.lit(0).cast("long"), lambda s, c: s + c["b"] - c["a"] + 1), F.lit(0).cast("long"))
    kept = F.filter(lines, lambda s, i: ~F.exists("cut", lambda c: i.between(c["a"], c["b"])))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines, n_removed = free_names(docs, ["n_lines", "n_removed"])
    same = [F.col("row")[c].alias(c) if c != text_col else text.alias(c) for c in docs.columns]
    return joined.select(*same, F.size(lines).cast("long").alias(n_lines), gone.alias(n_removed))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE = """
WITH l0 AS (SELECT rowid AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rowid, doc_id, text FROM documents)),
l1 AS (SELECT rid, doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS s FROM l0),
l2 AS (SELECT *, len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) AS words FROM l1),
l3 AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY line) AS pos, count(*) OVER (PARTITION BY s) AS n FROM l2 WHERE words > 0),
l4 AS (SELECT *, pos - row_number() OVER (PARTITION BY rid ORDER BY pos) AS seg FROM l3 WHERE n > 1),
l5 AS (SELECT *, sum(words) OVER (PARTITION BY rid, seg ORDER BY pos) AS after, sum(words) OVER (PARTITION BY rid, seg) AS total FROM l4),
l6 AS (SELECT *, after - words AS before FROM l5 WHERE total >= 50),
l7 AS (SELECT *, count(*) OVER (PARTITION BY rid, seg ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS ahead,
 count(*) OVER (PARTITION BY rid, seg ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS back FROM l6),
runs AS (SELECT rid, pos, ahead AS n FROM l7 WHERE before + 50 <= total UNION SELECT rid, pos - back + 1, back FROM l7 WHERE after >= 50),
named AS (SELECT r.rid, r.pos, r.n, string_agg(s, chr(10) ORDER BY l.pos) AS run FROM runs r JOIN l7 l ON l.rid = r.rid AND l.pos BETWEEN r.pos AND r.pos + r.n - 1 GROUP BY ALL),
firsts AS (SELECT *, first_value(rid) OVER w AS frid, first_value(pos) OVER w AS fpos FROM named WINDOW w AS (PARTITION BY n, run ORDER BY rid, pos)),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + n)) AS pos FROM firsts WHERE rid <> frid OR pos >= fpos + n),
isl AS (SELECT g.rid, min(line) AS a, max(line) AS b FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid ORDER BY pos) AS g FROM gone) g JOIN l7 USING (rid, pos) GROUP BY g.rid, g.g),
kept AS (SELECT l.rid, count(*) FILTER (WHERE i.rid IS NULL) AS n_kept, string_agg(s, chr(10) ORDER BY line) FILTER (WHERE i.rid IS NULL) AS t FROM l1 l LEFT JOIN isl i ON i.rid = l.rid AND line BETWEEN a AND b GROUP BY l.rid)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - n_kept)::BIGINT AS n_removed, length(coalesce(t, ''))::BIGINT AS kept_chars, md5(coalesce(t, '')) AS kept_md5
FROM l0 JOIN kept USING (rid)
"""
