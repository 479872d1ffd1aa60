"""URL filters: rules by host and path, and naive Bayes over segmented hosts for what no rule decides.

A host label such as `freebets` is split into words by unigram Viterbi. The word counts come from the whole visible text of all pages, together with the
seed words; only substrings of a label that are known words are looked up, in a join, so the vocabulary stays
distributed. Multinomial naive Bayes scores the words of the host (without its last label) and of the path. Rules block by domain and language, which says
nothing of a site, so they are no labels to learn from, and words that the rules themselves name are no evidence. Labels are seeds': a url whose segmented
words hold a seed of unwanted sites is an example of block, every other url, whatever a rule says of it, of an ordinary one. So a word that keeps company
with the seeds tells as well. A class's word shares are smoothed towards those of all urls, so that a word that is merely rare tells nothing. Labels and counts are kept by distinct label, so a hot host
counts as one row with a weight.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, materialize, quoted, table

#: (verdict, host, path), as the contract of the query gives them.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words of unwanted sites, and of ordinary ones. Each counts SEEN urls, or all of a class together SEED_SHARE of all words of urls, if that is more.
BLOCK_WORDS = ("adult", "bet", "bets", "betting", "bonus", "casino", "dating", "escort", "farm", "free", "gamble", "jackpot", "loan", "loans", "lottery", "nude", "pill", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "win", "winner", "xxx")
ALLOW_WORDS = ("about", "archive", "blog", "docs", "forum", "help", "home", "news", "school", "science", "shop", "support", "university", "wiki")
#: A url is blocked if its log odds, both classes as likely, are above those of PRIOR unwanted urls among all.
LONGEST, PRIOR, SEEN, SEED_SHARE = 20, 0.05, 2.0, 0.001
#: Smoothing: what the shares of words among all urls weigh beside a class's own.
SMOOTH_BLOCK, SMOOTH_ALLOW = 1.0, 0.01
MARGIN = math.log((1 - PRIOR) / PRIOR)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path; both empty for a null url or one without ://."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def best_split(label: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The most likely split of a label; known: (start, length) -> log probability; unknown: that of a character no word holds, which
    stays one word with its neighbours of the kind. Of equally likely splits the one with the longest last word wins."""
    n = len(label)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            p = known.get((start, end - start), unknown if end - start == 1 else -math.inf)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    cuts, end = [], n
    while end:
        cuts.append((back[end], end))
        end = back[end]
    out: list[str] = []
    loose = False
    for a, b in reversed(cuts):
        alone = (a, b - a) not in known
        if alone and loose:
            out[-1] += label[a:b]
        else:
            out.append(label[a:b])
        loose = alone
    return out


def segment(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, parts) for distinct labels of letters; words: (word, n)."""
    total = words.agg(F.sum("n")).first()[0] or 1
    spot = F.explode(F.expr(f"flatten(transform(sequence(1, length(label)), s -> transform(sequence(1, least({LONGEST}, length(label) - s + 1)), n -> struct(s AS s, n AS n, substring(label, s, n) AS word))))"))
    spots = labels.where("label <> ''").select("label", spot.alias("x")).select("label", "x.*")
    found = spots.join(words.withColumnRenamed("n", "c"), "word").groupBy("label").agg(F.collect_list(F.struct("s", "n", "c")).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for label, spots in zip(b["label"], b["found"], strict=True):
                known = {(x["s"] - 1, x["n"]): math.log(x["c"] / total) for x in (spots if spots is not None else ())}
                parts.append(best_split(label, known, math.log(0.1 / total)))
            yield pd.DataFrame({"label": b["label"], "parts": parts})

    return labels.where("label <> ''").join(found, "label", "left").mapInPandas(run, "label string, parts array<string>")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def visible(html: Column) -> Column:
    """A page's text without comments, scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, score). A null or malformed url has an empty host and no words: it is allowed. score is
    the method's log odds of block, for every url. With no page that has a text, the seed words alone decide. Null and repeated ids
    stay as they are; every row is judged by its url; other columns take no part, whatever their names. No rows give none."""
    host, path = split_url(quoted(url_col))
    urls = pages.select(quoted(id_col).alias("id"), host.alias("host"), path.alias("path"))
    sites = materialize(urls.groupBy("host", "path").agg(F.count("*").alias("n")), "sites")
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    seeds = pages.sparkSession.createDataFrame([(w,) for w in BLOCK_WORDS + ALLOW_WORDS], "word string")
    words = pages.select(F.explode(_words(visible(quoted(html_col)))).alias("word")).where(f"length(word) between 1 and {LONGEST}").groupBy("word").agg(F.count("*").alias("n"))
    words = materialize(words, "text-words")
    top = words.agg(F.sum("n")).first()[0] or 1
    lexicon = materialize(words.unionByName(seeds.select("word", F.lit(max(1, int(top * 1e-4))).alias("n"))).groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Host labels but the last, in pieces of letters; path words of at least three letters.
    labels = F.filter(F.flatten(F.transform(F.slice(F.split("host", r"\."), 1, F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(0))), _words)), lambda x: x != "")
    hosts = materialize(sites.groupBy("host").agg(F.sum("n").alias("n")).select("host", F.explode(labels).alias("label")), "labels")
    parts = segment(hosts.select("label").distinct(), lexicon)
    by_host = hosts.join(parts, "label").groupBy("host").agg(F.flatten(F.collect_list("parts")).alias("host_words"))
    named = sorted({w for _, h, p in rules for w in re.split(r"[^a-z]+", (h + p).lower()) if w} - set(BLOCK_WORDS) - set(ALLOW_WORDS))
    path_words = F.filter(_words(F.col("path")), lambda x: F.length(x) >= 3)
    tokens = F.filter(F.concat(F.coalesce("host_words", F.array().cast("array<string>")), path_words), lambda x: ~x.isin(named) if named else F.lit(True))
    bags = materialize(sites.join(by_host, "host", "left").withColumn("tokens", F.array_sort(tokens)).drop("host_words"), "bags")
    known = lambda ws: F.exists("tokens", lambda x: x.isin(list(ws)))
    each = bags.withColumn("bad", known(BLOCK_WORDS)).select("bad", "n", F.explode("tokens").alias("token"))
    counts = materialize(each.groupBy("token").agg(*[F.sum(F.when(F.col("bad") == b, F.col("n").cast("double")).otherwise(0.0)).alias(c) for c, b in (("block", True), ("allow", False))]), "counts")
    all_words = sum(counts.agg(F.coalesce(F.sum("block"), F.lit(0.0)), F.coalesce(F.sum("allow"), F.lit(0.0))).first())
    each_seed = lambda seeds: max(SEEN, SEED_SHARE * all_words / len(seeds))
    seeded = [(w, each_seed(BLOCK_WORDS), 0.0) for w in BLOCK_WORDS] + [(w, 0.0, each_seed(ALLOW_WORDS)) for w in ALLOW_WORDS]
    total = materialize(counts.unionByName(pages.sparkSession.createDataFrame(seeded, counts.schema)).groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "counts")
    n_block, n_allow = total.agg(F.sum("block"), F.sum("allow")).first()
    share = (F.col("block") + F.col("allow")) / (n_block + n_allow)
    of = lambda c, n, k: (F.col(c) + k * n * share) / (n + k * n)
    odds = F.log(of("block", n_block, SMOOTH_BLOCK)) - F.log(of("allow", n_allow, SMOOTH_ALLOW))
    one = bags.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    # Written: the bags then meet them in a join of two plain shuffles, whose large parts Spark can split.
    scored = materialize(one.join(total.select("token", odds.alias("odds")), "token").groupBy("tokens").agg(F.sum("odds").alias("odds")), "scored")
    judged = bags.join(scored, "tokens", "left").withColumn("score", F.coalesce("odds", F.lit(0.0)))
    judged = judged.select("host", "path", rule.alias("rule"), verdict.alias("by_rule"), "score")
    by_method = F.when(F.col("score") > MARGIN, "block").otherwise("allow")
    judged = materialize(judged.select("host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "score"), "judged")
    discard(sites, words, lexicon, hosts, bags, counts, total, scored)
    return urls.join(judged, ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: Of op8's columns, those that the rules alone decide; a test holds the query against it.
RULE_SQL = """
WITH h AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM h),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM p)
SELECT page_id, host, path, CASE
 WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
 WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
 WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM q
"""
