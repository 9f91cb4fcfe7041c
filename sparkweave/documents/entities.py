"""Entities and relations read from chunks: merging, folding of spellings, containment, refinement, linking, stamping.

Everything between the calls of a model is a join or an aggregate:

    entities:  chunk INT, key STRING, label STRING, props MAP<STRING, STRING>
    relations: chunk INT, src STRING, dst STRING, type STRING
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyzer import terms
from ..operators.vectors import batch_top_k

# Caps of the containment pairs, and what refinement may not touch.
PAIRS_PER_KEY = 4
PAIRS = 200
PROTECTED = ("embedding",)
#: Nodes that are offered for linking a chunk.
CANDIDATES = 8


def fold_key(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", ""))


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row a key: the label and each property of the first chunk that has them, and the chunks (`origins`)."""
    first = F.min_by(F.when(F.col("label") != "", F.col("label")), F.when(F.col("label") != "", F.col("chunk")))
    heads = entities.groupBy("key").agg(F.coalesce(first, F.lit("")).alias("label"), F.sort_array(F.collect_set("chunk")).alias("origins"))
    cells = entities.select("key", "chunk", F.explode_outer("props").alias("name", "value")).filter("name is not null")
    cells = cells.groupBy("key", "name").agg(F.min_by("value", "chunk").alias("value"))
    props = cells.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("props"))
    return heads.join(props, "key", "left").select("key", "label", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), "origins")


def merge_relations(relations: DataFrame) -> DataFrame:
    """Each (src, dst, type) once, from the first chunk that has it."""
    return relations.groupBy("src", "dst", "type").agg(F.min("chunk").alias("chunk"))


def fold_renames(names: DataFrame) -> DataFrame:
    """(name, count) to (name, survivor) for spellings that fold alike: the most frequent, ties by name."""
    folded = names.select("name", "count", fold_key(F.col("name")).alias("fold"))
    best = folded.groupBy("fold").agg(F.min_by("name", F.struct(-F.col("count"), F.col("name"))).alias("survivor"))
    return folded.join(best, "fold").filter("name <> survivor").select("name", "survivor")


def resolve_chains(renames: dict[str, str]) -> dict[str, str]:
    """A to B and B to C becomes A to C; a cycle ends where it closes. A vocabulary is small: one entry a name."""
    out = {}
    for name in renames:
        at, path = renames[name], {name}
        while at in renames and at not in path:
            path.add(at)
            at = renames[at]
        if at != name:
            out[name] = at
    return out


def containment_pairs(keys: DataFrame, per_key: int = PAIRS_PER_KEY, total: int = PAIRS) -> DataFrame:
    """(inner, outer) of keys (key, label) where one folded key is a proper part of another and the labels do not
    differ; the first few of each inner key, and of all, in the order of names.

    A folded inner key equals a substring of the outer one, so the pairs are an equi-join on the outer keys' substrings of
    the lengths that inner keys have, which are few and known before."""
    k = keys.select("key", F.lower("label").alias("label"), fold_key(F.col("key")).alias("fold")).filter("fold <> ''")
    n = F.length("fold")
    sizes = sorted(r[0] for r in k.select(n).distinct().collect())  # a number a length
    cut = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.substr("fold", at, size))
    grams = F.explode(F.array_distinct(F.flatten(F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda size: size < n), cut))))
    outer = k.filter(n > 1).select(F.col("key").alias("outer"), F.col("label").alias("outer_label"), grams.alias("fold"))
    pairs = k.withColumnRenamed("key", "inner").join(outer, "fold")
    alike = (F.coalesce("label", F.lit("")) == "") | (F.coalesce("outer_label", F.lit("")) == "") | (F.col("label") == F.col("outer_label"))
    first = pairs.filter(alike).withColumn("at", F.row_number().over(Window.partitionBy("inner").orderBy("outer"))).filter(F.col("at") <= per_key)
    return first.select("inner", "outer").orderBy("inner", "outer").limit(total)


def apply_renames(entities: DataFrame, relations: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities under their survivors (whose own values come first, gaps are filled), and relations between them
    without self-loops and repeats. renames: name, survivor."""
    moved = entities.join(renames.select(F.col("name").alias("key"), "survivor"), "key", "left")
    own = moved.select(F.coalesce("survivor", "key").alias("key"), F.struct(F.col("survivor").isNotNull().alias("other"), F.col("key").alias("from")).alias("rank"), "label", "props", "origins")
    label = F.min_by(F.when(F.col("label") != "", F.col("label")), F.when(F.col("label") != "", F.col("rank")))
    heads = own.groupBy("key").agg(F.coalesce(label, F.lit("")).alias("label"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"))
    cells = own.select("key", "rank", F.explode("props").alias("name", "value")).groupBy("key", "name").agg(F.min_by("value", "rank").alias("value"))
    props = cells.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("props"))
    out = heads.join(props, "key", "left").select("key", "label", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), "origins")
    rel = relations
    for end in ("src", "dst"):
        rel = rel.join(renames.select(F.col("name").alias(end), F.col("survivor").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return out, merge_relations(rel.filter("src <> dst").select("chunk", "src", "dst", "type"))


def mention_gate(chunks: DataFrame, entities: DataFrame, relations: DataFrame, lang: str = "english") -> DataFrame:
    """key, fresh, context, degree, n_props of entities that a chunk mentions which did not produce them: the chunk
    holds every term of the key. chunks: ord, chunk. Ranked by degree, then few properties, then key (`rank`).

    The join is on one term of each key, its rarest, so a frequent word does not pair all chunks with all keys."""
    words = chunks.select("ord", F.array_distinct(terms(F.col("chunk"), lang)).alias("terms"))
    df = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    wanted = entities.select("key", "origins", F.size("props").alias("n_props"), F.array_distinct(terms(F.col("key"), lang)).alias("wanted")).filter("size(wanted) > 0")
    rare = wanted.select("key", F.explode("wanted").alias("term")).join(df, "term", "left").groupBy("key").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"))
    hits = wanted.join(rare, "key").join(words.select("ord", "terms", F.explode("terms").alias("term")), "term")
    hits = hits.filter(F.size(F.array_except("wanted", "terms")) == 0)
    found = hits.groupBy("key").agg(F.first("origins").alias("origins"), F.first("n_props").alias("n_props"), F.sort_array(F.collect_set("ord")).alias("mentions"))
    ends = relations.select(F.col("src").alias("key")).union(relations.select("dst")).groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    fresh = found.withColumn("fresh", F.array_except("mentions", "origins")).filter("size(fresh) > 0")
    out = fresh.join(ends, "key", "left").select("key", F.sort_array("fresh").alias("fresh"), F.sort_array(F.array_union("origins", "fresh")).alias("context"), F.coalesce("degree", F.lit(0)).alias("degree"), "n_props")
    return out.orderBy(F.desc("degree"), "n_props", "key")


def refine(entities: DataFrame, read: DataFrame) -> DataFrame:
    """Entities with the properties of `read` (key, props) put over theirs; names that begin with _ and embeddings are
    not touched."""
    allowed = F.map_filter("new", lambda k, _: ~k.startswith("_") & ~k.isin(*PROTECTED))
    both = entities.join(read.select("key", F.col("props").alias("new")), "key", "left").withColumn("new", F.coalesce(allowed, F.create_map().cast("map<string,string>")))
    kept = F.map_filter("props", lambda k, _: ~F.array_contains(F.map_keys("new"), k))
    return both.select("key", "label", F.map_concat(kept, "new").alias("props"), "origins")


def link(entities: DataFrame, relations: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entities, relations whose ends are new or exist, and the ones dropped. existing: key."""
    new = entities.join(existing.select("key"), "key", "left_anti")
    keys = entities.select("key").union(existing.select("key")).distinct()
    good = relations
    for end in ("src", "dst"):
        good = good.join(keys.select(F.col("key").alias(end)), end, "left_semi")
    return new, good, relations.join(good, ["src", "dst", "type"], "left_anti")


def stamp(entities: DataFrame, source: str, model: str, run: str) -> DataFrame:
    """Entities with where they came from: _source, _model and _run."""
    marks = F.create_map(*(F.lit(x) for kv in (("_source", source), ("_model", model), ("_run", run)) for x in kv))
    kept = F.map_filter("props", lambda k, _: ~k.isin("_source", "_model", "_run"))
    return entities.withColumn("props", F.map_concat(kept, marks))


def entity_text(entities: DataFrame) -> DataFrame:
    """key and text that an entity is embedded from: key, label, then its properties by name (hidden ones left out)."""
    shown = F.map_filter("props", lambda k, v: ~k.startswith("_") & ~k.isin(*PROTECTED) & v.isNotNull())
    lines = F.transform(F.sort_array(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    head = F.when(F.coalesce("label", F.lit("")) != "", F.concat("key", F.lit(" ("), "label", F.lit(")"))).otherwise(F.col("key"))
    return entities.select("key", F.concat_ws("\n", F.array(head), lines).alias("text"))


def fact_text(relations: DataFrame) -> DataFrame:
    """src, dst, type and the text that a relation is embedded from: what it joins, in its direction."""
    return relations.select("src", "dst", "type", F.concat_ws(" ", "src", "type", "dst").alias("text"))


def candidates(chunks: DataFrame, nodes: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """chunk, key, score: the k keyed nodes (id, key, vector) nearest to each chunk (chunk, vector) by cosine, as what a
    reader may link to. One blocked product for all chunks."""
    named = nodes.filter("key is not null and vector is not null")
    found = batch_top_k(chunks.select(F.col("chunk").alias("id"), "vector"), named.select("id", "vector"), k)
    return found.join(named.select("id", "key"), "id").select(F.col("query").alias("chunk"), "key", (1 - F.col("distance")).alias("score"))


def fold_facts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts of a parser win over what a model read of the same key; the rest is added. Both: key, label, props,
    origins."""
    return facts.unionByName(entities.join(facts.select("key"), "key", "left_anti"))


def write_proposal(entities: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A proposal's entities to create (first of each key, `Entity` where there is no label), and the keys skipped as
    taken or repeated (key, why)."""
    ranked = entities.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("label")))
    taken = existing.select("key", F.lit(True).alias("taken"))
    ranked = ranked.join(taken, "key", "left")
    new = ranked.filter("taken is null and at = 1").select("key", F.when(F.coalesce("label", F.lit("")) == "", "Entity").otherwise(F.col("label")).alias("label"), "props", "origins")
    skipped = ranked.filter("taken or at > 1").select("key", F.when(F.col("taken"), "taken").otherwise("repeated").alias("why"))
    return new, skipped


def synced(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """What brings stored facts to a new set (both: key, label, props): key and op, one of create, replace (another
    label), patch (other properties), delete, same."""
    a = facts.select("key", F.col("label").alias("l"), F.sort_array(F.map_entries("props")).alias("p"))
    b = stored.select("key", F.col("label").alias("m"), F.sort_array(F.map_entries("props")).alias("q"))
    both = a.withColumn("new", F.lit(True)).join(b.withColumn("old", F.lit(True)), "key", "full")
    op = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(~F.col("l").eqNullSafe(F.col("m")), "replace").when(~F.col("p").eqNullSafe(F.col("q")), "patch").otherwise("same")
    return both.select("key", op.alias("op"))
