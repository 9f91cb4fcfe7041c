"""What to fetch next, over a table of pages instead of a network: relevance, addresses, robots rules, the frontier."""

from __future__ import annotations

import re

from functools import reduce
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyzer import query_terms, terms
from ..storage import cut

# Terms of the root page, weight of a topic term, saturation, bonuses, decay, floor and budget.
ROOT_TERMS = 40
TOPIC_WEIGHT = 3.0
K1, B = 1.2, 0.75
MAIN_BONUS, HOST_BONUS = 1.25, 1.15
DEPTH_DECAY, FLOOR = 0.5, 0.25
PAGES = 10
DEPTH = 2


def target(root: DataFrame, topic: str | None = None, lang: str = "english") -> dict[str, float]:
    """Weight of each term that pages are held against: the root's (text) most frequent terms, by their share of the
    most frequent one's count, and the topic's. Forty terms and a topic's, so it is a Python table."""
    counts = root.select(F.explode(terms(F.col("text"), lang)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "t").limit(ROOT_TERMS).collect()
    out = {r["t"]: r["n"] / top[0]["n"] for r in top}
    if topic:
        for t in query_terms(topic, lang):
            out[t] = out.get(t, 0.0) + TOPIC_WEIGHT
    return out


def _scale(weights: dict[str, float], raw: Column) -> Column:
    total = sum(weights.values()) * (K1 + 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / total)) if total > 0 else F.lit(0.0)


def _weight_of(weights: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv)) if weights else F.lit(None).cast("map<string,double>")


def score(pages: DataFrame, weights: dict[str, float], lang: str = "english") -> DataFrame:
    """page_id and relevance (0 to 1) of texts, with the length normalised by the mean of all."""
    toks = cut(pages.select("page_id", terms(F.col("text"), lang).alias("terms")).select("page_id", F.size("terms").alias("len"), "terms"), "terms")
    mean = toks.agg(F.avg("len")).first()[0] or 0.0
    long = F.col("len") / mean if mean > 0 else F.lit(1.0)
    tf = toks.select("page_id", "len", F.explode("terms").alias("t")).filter(F.col("t").isin(*weights)).groupBy("page_id", "len", "t").agg(F.count(F.lit(1)).alias("f"))
    part = _weight_of(weights)[F.col("t")] * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * long))
    got = tf.withColumn("part", part).groupBy("page_id").agg(F.sum("part").alias("raw"))
    return toks.select("page_id").join(got, "page_id", "left").select("page_id", _scale(weights, F.coalesce("raw", F.lit(0.0))).alias("relevance"))


def coverage(text_terms: Column, weights: dict[str, float]) -> Column:
    """Share of the target's weight that a short text mentions at all."""
    parts = [F.when(F.array_contains(text_terms, t), w).otherwise(0.0) for t, w in sorted(weights.items())]
    return _scale(weights, reduce(lambda a, b: a + b, parts, F.lit(0.0)))


def url_words(url: Column) -> Column:
    """The words of an address's path, with camel case parted, each followed by a space."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    # a capital after what is no capital begins a word
    parted = F.regexp_replace(path, r"(?<=[\p{IsAlphabetic}\p{N}])(?<!\p{Lu})(?=\p{Lu})", " ")
    words = F.filter(F.split(parted, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" "))), "")


def normalize_url(url: Column) -> Column:
    """Scheme, host in lower case, path without trailing slashes, query; no fragment. NULL if it is no address."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    query = F.when(part("QUERY").isNotNull(), F.concat(F.lit("?"), part("QUERY"))).otherwise("")
    return F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.lower(part("HOST")), F.regexp_replace(part("PATH"), "/+$", ""), query)


# robots.txt


def robots_rules(text: str, agent: str) -> list[tuple[str, bool]]:
    """(pattern, allow) of the group with the longest name that the agent's begins with or holds; else of *."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    names: list[str] = []
    in_rules = False
    for raw in text.splitlines():
        field, _, value = raw.split("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if in_rules:
                names, in_rules = [], False
            names.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            in_rules = True
            if value:
                for n in names:
                    groups[n].append((value, field == "allow"))
    own = [n for n in groups if n != "*" and n in agent.lower()]
    return groups[max(own, key=len)] if own else groups.get("*", [])


def robots_allow(rules: list[tuple[str, bool]], path: str) -> bool:
    """The longest pattern that matches decides; of equals, allow. * stands for anything, $ at the end for the end."""
    hits = []
    for pattern, allow in rules:
        ends = pattern.endswith("$")
        body = ".*?".join(map(re.escape, (pattern[:-1] if ends else pattern).split("*")))
        if re.match(body + ("$" if ends else ""), path, re.DOTALL):
            hits.append((len(pattern), allow))
    return max(hits)[1] if hits else True


def robots_column(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """robots_allow over a column of paths: rules from the longest pattern down, allow before disallow, as a CASE."""
    out = None
    for pattern, allow in sorted(rules, key=lambda r: (-len(r[0]), not r[1])):
        ends = pattern.endswith("$")
        body = ".*?".join(rf"\Q{p}\E" if p else "" for p in (pattern[:-1] if ends else pattern).split("*"))
        hit = path.rlike("(?s)^" + body + ("$" if ends else ""))
        out = F.when(hit, allow) if out is None else out.when(hit, allow)
    return F.lit(True) if out is None else out.otherwise(True)


# The frontier


def resolve_links(pages: DataFrame) -> DataFrame:
    """page_id, to (normalised), anchor, in_main, same_host of extracted pages' links."""

    @F.pandas_udf("string")
    def join(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([_joined(b, h) for b, h in zip(base, href, strict=True)])

    rows = pages.select("page_id", "url", F.explode("links").alias("l")).select("page_id", "url", "l.*")
    rows = rows.withColumn("to", join("url", "href"))
    host = lambda c: F.lower(F.try_parse_url(F.col(c), F.lit("HOST")))
    out = rows.select("page_id", normalize_url(F.col("to")).alias("to"), "anchor", "in_main", F.coalesce(host("to") == host("url"), F.lit(False)).alias("same_host"))
    return out.filter("to is not null")


def _joined(base: str | None, href: str) -> str | None:
    try:
        url = urljoin(base or "", href)
        return url if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def pre_score(links: DataFrame, weights: dict[str, float], lang: str = "english") -> DataFrame:
    """Links with `pre`: coverage by anchor text and address words, with bonuses for place and host."""
    if not weights:
        return links.withColumn("pre", F.lit(1.0))
    seen = terms(F.concat_ws(" ", "anchor", url_words(F.col("to"))), lang)
    bonus = F.when(F.col("in_main"), MAIN_BONUS).otherwise(1.0) * F.when(F.col("same_host"), HOST_BONUS).otherwise(1.0)
    return links.withColumn("seen", seen).withColumn("pre", coverage(F.col("seen"), weights) * bonus).drop("seen")


def crawl(pages: DataFrame, root: str, topic: str | None = None, depth: int = DEPTH, budget: int = PAGES) -> DataFrame:
    """url, depth, relevance of the pages kept, from a root address through the links of extracted pages (page_id, url,
    markdown, links). At each depth the links with the best score times decay are followed while the budget lasts;
    pages under a share of the best relevance of their depth are dropped and not followed."""
    pages = cut(pages.withColumn("at", normalize_url(F.col("url"))), "pages")
    weights = target(pages.filter(F.col("at") == normalize_url(F.lit(root))).select(F.col("markdown").alias("text")), topic)
    rel = score(pages.select("page_id", F.col("markdown").alias("text")), weights)
    pages = cut(pages.join(rel, "page_id"), "pages")
    links = cut(pre_score(resolve_links(pages), weights), "links")
    seen = pages.filter(F.col("at") == normalize_url(F.lit(root))).select("at").distinct()
    level = cut(pages.join(seen, "at", "left_semi").select("page_id", "at", "relevance", F.lit(0).alias("depth")), "level")
    kept, left = [level], budget - 1
    visited = cut(seen, "visited")
    for d in range(1, depth + 1):
        if left <= 0:
            break
        out = links.join(level.select("page_id"), "page_id", "left_semi").groupBy("to").agg(F.max("pre").alias("pre"))
        out = out.join(visited.withColumnRenamed("at", "to"), "to", "left_anti").withColumn("pre", F.col("pre") * DEPTH_DECAY ** (d - 1))
        first = cut(pages.join(out.withColumnRenamed("to", "at"), "at").withColumn("n", F.row_number().over(Window.partitionBy("at").orderBy("page_id"))).filter("n = 1").orderBy(F.desc("pre"), "at").limit(left), "fetched")
        got = first.agg(F.count(F.lit(1)), F.max("relevance")).first()
        if not got[0]:
            break
        left -= got[0]
        visited = cut(visited.union(first.select("at")), "visited")
        level = cut(first.filter(F.col("relevance") >= FLOOR * got[1]).select("page_id", "at", "relevance", F.lit(d).alias("depth")), "level")
        kept.append(level)
    return reduce(DataFrame.unionByName, kept).select(F.col("at").alias("url"), "depth", "relevance")


def route(files: DataFrame, handlers: dict[str, str]) -> DataFrame:
    """Files (path) with the handler that claims their extension; NULL for the plain reader."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in handlers.items() for x in kv)) if handlers else F.lit(None).cast("map<string,string>")
    return files.withColumn("handler", known[ext])


def read_documents(spark, path: str) -> DataFrame:
    """path and text of Markdown and plain text files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown,txt}").load(path)
    return files.select("path", F.col("content").cast("string").alias("text"))
