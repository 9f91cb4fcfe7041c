"""A logical plan as one lazy DataFrame.

A row is a current node (head), the number of hops to it, a score, and, only where something reads them, the trail of
(edge, node) and the columns that define the order of rows. Three rules keep plans small:

* Order columns are carried only if a later step or the caller depends on row order.
* Between two expansions, the properties, labels and keys that steps read are known beforehand; they are joined once,
  with nothing else, or scanned with the source so that filters reach the files.
* A label test right after an expansion narrows the tables that the join reads.

Where only numbers of rows are asked for, rows of one head, hops and score are merged after each hop and carry how many
they stand for, so that walks which meet are extended once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import Row, distance, evaluate, predicate, similarity, similarity_of_distance, vector_of
from ..functions.values import literal, sort_keys
from ..plans import model as M
from ..sources.graph import Graph
from ..storage import cut
from . import algorithms, hybrid, keyword, vectors

MOVES = (M.Expand, M.ExpandVar, M.ExpandBeam)


@dataclass(frozen=True)
class Needs:
    """What the steps of one segment read of the current node."""

    props: tuple[str, ...] = ()
    key: bool = False
    labels: bool = False

    @staticmethod
    def of(exprs: list[M.Expr], more: tuple[str, ...] = ()) -> Needs:
        props, key, labels = list(more), False, False
        for e in exprs:
            for x in M.walk(e):
                match x:
                    case M.Property(name):
                        props.append(name)
                    case M.Distance() | M.Similarity():
                        props.append(x.property)
                    case M.ExternalKey():
                        key = True
                    case M.HasLabel():
                        labels = True
        return Needs(tuple(dict.fromkeys(props)), key, labels)


@dataclass(frozen=True)
class State:
    df: DataFrame
    labels: frozenset[str] | None  # that the head may have; None: any
    order: tuple[str, ...] = ()
    descending: tuple[bool, ...] = ()
    needs: Needs = Needs()


class Lowering:
    def __init__(self, graph: Graph, plan: M.LogicalPlan, ordered: bool = False, trail: bool = False, exprs: tuple[M.Expr, ...] = (), counted: bool = False):
        self.graph, self.plan, self.ordered, self.trail, self.exprs = graph, plan, ordered, trail, exprs
        self.steps = list(plan.steps)
        #: Rows have a column `walks`, how many they stand for. Steps that take rows by their place need each of them.
        self.counted = counted and not trail and not self.order_needed(0)
        self.fresh = 0

    # what later steps need

    def order_needed(self, i: int) -> bool:
        """Does anything from step i on depend on row order?"""
        return self.ordered or any(isinstance(s, (M.Skip, M.Limit, M.Distinct, M.FrontierTopK, M.ExpandBeam)) for s in self.steps[i:])

    def segment(self, i: int) -> Needs:
        """What the steps from i to the next move, and the caller if there is none, read."""
        exprs: list[M.Expr] = []
        props: list[str] = []
        for s in self.steps[i:]:
            if isinstance(s, MOVES):
                break
            if isinstance(s, M.Filter):
                exprs.append(s.expr)
            elif isinstance(s, M.Sort):
                exprs += [k.expr for k in s.keys]
            elif isinstance(s, M.FrontierTopK):
                props.append(s.property)
        else:
            exprs += self.exprs
        return Needs.of(exprs, tuple(props))

    def name(self, what: str) -> str:
        self.fresh += 1
        return f"__{what}{self.fresh}"

    # rows

    def row(self, st: State) -> Row:
        values = self.graph.values(st.labels, st.needs.props)

        def has_label(label: str) -> Column:
            tables = self.graph.tables(st.labels)
            if tables and all(t.labels is not None and label in t.labels for t in tables):
                return F.lit(True)
            if all(t.labels is not None and label not in t.labels for t in tables):
                return F.lit(False)
            return F.array_contains("__labels", label)

        return Row(lambda p: values[p], has_label, F.col("__key") if st.needs.key else F.lit(None).cast("string"), F.col("score"), F.col("hops"))

    def base(self, df: DataFrame, st_labels: frozenset[str] | None, needs: Needs, order: list[Column], score: Column | None = None) -> State:
        names = [self.name("o") for _ in order]
        df = df.withColumns({n: c for n, c in zip(names, order, strict=True)} | {"head": F.col("id"), "hops": F.lit(0), "score": (F.lit(None) if score is None else score).cast("float")} | ({"trail": F.array().cast("array<struct<edge:bigint,node:bigint>>")} if self.trail else {}) | ({"walks": F.lit(1).cast("bigint")} if self.counted else {}))
        return State(df.drop("id"), st_labels, tuple(names), (False,) * len(names), needs)

    def attach(self, st: State, needs: Needs) -> State:
        """Join what the next steps read of the heads."""
        if not (needs.props or needs.key or needs.labels and self.labels_open(st.labels)):
            return replace(st, needs=needs)
        nodes = self.graph.nodes(st.labels, needs.props, needs.key, needs.labels)
        return replace(st, df=st.df.join(nodes.withColumnRenamed("id", "head"), "head"), needs=needs)

    def labels_open(self, labels: frozenset[str] | None) -> bool:
        sets = {t.labels for t in self.graph.tables(labels)}
        return None in sets or len(sets) > 1

    def kept(self, st: State) -> list[str]:
        """Columns that a row keeps when it moves on."""
        return [*st.order, "hops", "score", *(["trail"] if self.trail else []), *(["walks"] if self.counted else [])]

    def merged(self, rows: DataFrame) -> DataFrame:
        """Rows that later steps cannot tell apart as one, if only their number is asked for."""
        return rows.groupBy("head", "hops", "score").agg(F.sum("walks").alias("walks")) if self.counted else rows

    # sources

    def source(self) -> State:
        g, s, needs = self.graph, self.plan.source, self.segment(0)
        match s:
            case M.ScanAll():
                return self.base(g.nodes(None, needs.props, needs.key, needs.labels), None, needs, [F.col("id")] if self.order_needed(0) else [])
            case M.ScanLabel(label):
                labels = frozenset([label])
                return self.base(g.nodes(labels, needs.props, needs.key, needs.labels), labels, needs, [F.col("id")] if self.order_needed(0) else [])
            case M.SeekIds(ids):
                at = g.spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "pos int, id long")
                return self.base(self.sought(at, "id", needs), None, needs, [F.col("pos")])
            case M.SeekKeys(keys):
                at = g.spark.createDataFrame([(i, x) for i, x in enumerate(keys)], "pos int, __key string")
                return self.base(self.sought(at, "__key", replace(needs, key=True)), None, replace(needs, key=True), [F.col("pos")])
            case M.VectorTopK():
                labels = frozenset([s.label]) if s.label is not None else None
                index = g.vector_indexes.get((s.label, s.property))
                if index is not None and index.metric == s.metric:
                    hits = vectors.nearest(index, list(s.query), s.k)
                else:
                    hits = vector_top_k(g, labels, s.property, s.query, s.metric, s.k)
                return self.hits(hits.select("id", similarity_of_distance(s.metric, F.col("distance")).alias("value")), labels, needs)
            case M.KeywordTopK():
                return self.hits(keyword.top_k(g, s.label, s.property, s.query, s.k).select("id", F.col("score").alias("value")), frozenset([s.label]), needs)
            case M.Hybrid():
                return self.hits(hybrid.run(g, s).select("id", F.col("score").alias("value")), None, needs)
            case M.Algo(label, algo):
                labels = frozenset([label]) if label is not None else None
                found, order = algorithms.rows(g, labels, algo)
                return self.attach(self.base(found, labels, Needs(), [F.col(c) if not c.startswith("-") else -F.col(c[1:]) for c in order], F.col("value")), needs)
        raise TypeError(f"no source {s}")

    def sought(self, at: DataFrame, on: str, needs: Needs) -> DataFrame:
        # the list is part of the plan's text, so its size is that of the plan
        nodes = self.graph.nodes(None, needs.props, needs.key, needs.labels)
        return nodes.join(F.broadcast(at), on)

    def hits(self, hits: DataFrame, labels: frozenset[str] | None, needs: Needs) -> State:
        return self.attach(self.base(hits, labels, Needs(), [-F.col("value"), F.col("id")], F.col("value")), needs)

    # steps

    def run(self) -> State:
        st = self.source()
        i = 0
        while i < len(self.steps):
            step = self.steps[i]
            st = self.step(st, i, step)
            i += 1
        return st

    def step(self, st: State, i: int, step: M.Step) -> State:
        match step:
            case M.Filter(e):
                return replace(st, df=st.df.filter(predicate(e, self.row(st))))
            case M.Expand():
                return self.expand_to(st, i, step) if self.ahead(i) else self.attach(self.expand(st, i, step.dir, step.edge_type), self.segment(i + 1))
            case M.ExpandVar():
                return self.attach(self.expand_var(st, i, step), self.segment(i + 1))
            case M.ExpandBeam():
                return self.beam(st, i, step)
            case M.FrontierTopK():
                return self.frontier(st, step)
            case M.Skip(n):
                return replace(st, df=self.sorted(st).offset(n))
            case M.Limit(n):
                return replace(st, df=self.sorted(st).limit(n))
            case M.Distinct():
                return self.distinct(st, i)
            case M.Sort(keys):
                return self.sort(st, i, keys)
        raise TypeError(f"no step {step}")

    def ahead(self, i: int) -> str | None:
        """The label that the next step asks for, if it is a plain label test."""
        nxt = self.steps[i + 1] if i + 1 < len(self.steps) else None
        e = nxt.expr if isinstance(nxt, M.Filter) else None
        while isinstance(e, M.Logic) and e.op == "And":
            e = e.lhs
        return e.label if isinstance(e, M.HasLabel) else None

    def expand_to(self, st: State, i: int, step: M.Expand) -> State:
        label = self.ahead(i)
        out = self.expand(st, i, step.dir, step.edge_type)
        known = self.graph.known_labels()
        if out.labels is not None and label not in out.labels and known is not None:
            # fixed labels: a table of another label may still carry this one beside its own
            out = replace(out, labels=frozenset())
        if out.labels != frozenset():
            only = frozenset([label])
            closed = all(t.labels is not None for t in self.graph.tables(only))
            implied = closed and out.labels is not None and all(t.labels is None or label in t.labels for t in self.graph.tables(out.labels))
            out = replace(out, labels=only)
            needs = self.segment(i + 1)
            if not implied and not (needs.props or needs.key or self.labels_open(only)):
                ids = self.graph.nodes(only).withColumnRenamed("id", "head")
                return replace(out, df=out.df.join(ids, "head", "left_semi"), needs=needs)
        return self.attach(out, self.segment(i + 1))

    def sorted(self, st: State) -> DataFrame:
        if not st.order:
            return st.df
        return st.df.orderBy(*(F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in zip(st.order, st.descending, strict=True)))

    def hop(self, st: State, adjacency: DataFrame) -> DataFrame:
        rows = st.df.select("head", *self.kept(st)).withColumnRenamed("head", "near").join(adjacency, "near")
        rows = rows.withColumn("hops", F.col("hops") + 1)
        if self.trail:
            rows = rows.withColumn("trail", F.concat("trail", F.array(F.struct(F.col("edge"), F.col("far").alias("node")))))
        return rows.withColumnRenamed("far", "head")

    def expand(self, st: State, i: int, direction: str, edge_type: str | None) -> State:
        far = self.graph.far_labels(st.labels, direction, edge_type)
        rows = self.hop(st, self.graph.adjacency(direction, edge_type, st.labels))
        order, desc = list(st.order), list(st.descending)
        if self.order_needed(i + 1):
            for what, c in (("d", F.col("dir")), ("t", self.graph.type_rank(F.col("type"))), ("t", F.col("type")), ("n", F.col("head")), ("e", F.col("edge"))):
                n = self.name(what)
                rows, order, desc = rows.withColumn(n, c), [*order, n], [*desc, False]
        else:
            order, desc = [], []
        out = rows.select("head", *self.kept(replace(st, order=tuple(order))))
        return State(self.merged(out), far, tuple(order), tuple(desc))

    def expand_var(self, st: State, i: int, step: M.ExpandVar) -> State:
        """Levels 0..max of walks, of which those from min on are kept. The order is that of a depth-first walk which
        takes the last neighbour first: a path of descending steps, in which a walk comes before its continuations."""
        ordered = self.order_needed(i + 1)
        path = self.name("path")
        level = replace(st, df=st.df.select("head", *self.kept(st)))
        kind = "array<struct<d:int,t:int,y:string,n:bigint,e:bigint>>"
        if ordered:
            level = replace(level, df=level.df.withColumn(path, F.array().cast(kind)), order=(*st.order, path), descending=(*st.descending, False))
        out = level.df if step.min == 0 else None
        labels = st.labels if step.min == 0 else frozenset()
        here = st.labels
        for k in range(1, step.max + 1):
            rows = self.hop(replace(level, labels=here), self.graph.adjacency(step.dir, step.edge_type, here))
            if ordered:
                step_key = F.struct((-F.col("dir")).alias("d"), (-self.graph.type_rank(F.col("type"))).cast("int").alias("t"), F.lit("").alias("y"), (-F.col("head")).alias("n"), (-F.col("edge")).alias("e"))
                rows = rows.withColumn(path, F.concat(path, F.array(step_key)))
            here = self.graph.far_labels(here, step.dir, step.edge_type)
            level = replace(level, df=self.merged(rows.select("head", *self.kept(level))))
            if k >= step.min:
                out = level.df if out is None else out.unionByName(level.df)
                labels = None if labels is None or here is None else labels | here
        return State(out, labels, level.order if ordered else (), level.descending if ordered else ())

    def scored(self, st: State, prop: str, query, metric: str) -> tuple[DataFrame, Column]:
        """Rows whose property is a vector of the query's length, and its distance."""
        c = vector_of(self.row(st).property(prop))
        df = st.df.filter(c.isNotNull() & (F.size(c) == len(query)))
        return df, distance(metric, c, literal(M.Vector(query)).col)

    def frontier(self, st: State, step: M.FrontierTopK) -> State:
        df, d = self.scored(st, step.property, step.query, step.metric)
        n = self.name("dist")
        df = df.withColumn(n, d).withColumn("score", similarity_of_distance(step.metric, F.col(n)).cast("float"))
        out = replace(st, df=df, order=(n, *st.order), descending=(False, *st.descending))
        return replace(out, df=self.sorted(out).limit(step.k))

    def beam(self, st: State, i: int, step: M.ExpandBeam) -> State:
        """Per level, the best `width` neighbours by similarity (a node without the vector comes last)."""
        levels, level = [], st
        lv, rank = self.name("level"), self.name("rank")
        needs = Needs((step.property,))
        for k in range(step.depth):
            far = self.graph.far_labels(level.labels, step.dir, step.edge_type)
            rows = self.hop(replace(level, order=(), descending=()), self.graph.adjacency(step.dir, step.edge_type, level.labels))
            at = self.attach(State(rows.select("head", "edge", "hops", "score", *(["trail"] if self.trail else [])), far), needs)
            c = vector_of(self.row(at).property(step.property))
            sim = F.when(c.isNull() | (F.size(c) != len(step.query)), float("-inf")).otherwise(similarity(step.metric, c, literal(M.Vector(step.query)).col))
            df = at.df.withColumn(rank, -sim).withColumn("score", sim.cast("float")).withColumn(lv, F.lit(k))
            df = df.orderBy(rank, "head", "edge").limit(step.width)
            # the kept rows are both a result and the next level's start: bounded by width, written once
            df = cut(df.select("head", "hops", "score", rank, lv, *(["trail"] if self.trail else [])), "beam")
            level = State(df, far)
            levels.append(level)
        if not levels:
            return replace(st, df=st.df.filter(F.lit(False)))
        df = levels[0].df
        labels = levels[0].labels
        for x in levels[1:]:
            df = df.unionByName(x.df)
            labels = None if labels is None or x.labels is None else labels | x.labels
        return self.attach(State(df.withColumn(n := self.name("h"), F.col("head")), labels, (lv, rank, n), (False, False, False)), self.segment(i + 1))

    def distinct(self, st: State, i: int) -> State:
        """The first row of each head. Partially aggregated, so a head with many rows is no burden."""
        rest = [c for c in st.df.columns if c != "head"]
        if not st.order:
            return replace(st, df=st.df.groupBy("head").agg(F.first(F.struct(*rest)).alias("r")).select("head", "r.*"))
        if any(st.descending):
            w = Window.partitionBy("head").orderBy(*(F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in zip(st.order, st.descending, strict=True)))
            n = self.name("first")
            return replace(st, df=st.df.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n))
        return replace(st, df=st.df.groupBy("head").agg(F.min_by(F.struct(*rest), F.struct(*st.order)).alias("r")).select("head", "r.*"))

    def sort(self, st: State, i: int, keys: tuple[M.SortKey, ...]) -> State:
        df, names, desc = st.df, [], []
        row = self.row(st)
        for k in keys:
            for c in sort_keys(evaluate(k.expr, row)):
                n = self.name("s")
                df = df.withColumn(n, c)
                names.append(n)
                desc.append(k.descending)
        return replace(st, df=df, order=(*names, *st.order), descending=(*desc, *st.descending))


def vector_top_k(graph: Graph, labels: frozenset[str] | None, prop: str, query, metric: str, k: int) -> DataFrame:
    """id and distance of the k nodes whose vector is closest; ties by id. Each task keeps its own k first."""
    nodes = graph.nodes(labels, [prop])
    c = vector_of(graph.values(labels, [prop])[prop])
    near = nodes.filter(c.isNotNull() & (F.size(c) == len(query))).select("id", distance(metric, c, literal(M.Vector(query)).col).alias("distance"))
    return near.orderBy("distance", "id").limit(k)


def vectors_of(graph: Graph, label: str, prop: str) -> DataFrame:
    """id and vector of a label's nodes; NULL where the property is no vector."""
    labels = frozenset([label])
    return graph.nodes(labels, [prop]).select("id", vector_of(graph.values(labels, [prop])[prop]).alias("vector"))


# Terminals -----------------------------------------------------------------------------------------------------


class Query:
    """Builds a plan step by step and runs it."""

    def __init__(self, graph: Graph, plan: M.LogicalPlan | None = None):
        self.graph, self._plan = graph, plan or M.LogicalPlan(M.ScanAll())

    def _from(self, source: M.Source) -> Query:
        return Query(self.graph, M.LogicalPlan(source, self._plan.steps))

    def then(self, step: M.Step) -> Query:
        return Query(self.graph, M.LogicalPlan(self._plan.source, (*self._plan.steps, step)))

    def scan_all(self):
        return self._from(M.ScanAll())

    def scan_label(self, label: str):
        return self._from(M.ScanLabel(label))

    def seek_ids(self, ids):
        return self._from(M.SeekIds(tuple(ids)))

    def seek_keys(self, keys):
        return self._from(M.SeekKeys(tuple(keys)))

    def vector_top_k(self, label, prop, query, k, metric="Cosine"):
        return self._from(M.VectorTopK(label, prop, M.Vector(query), metric, k))

    def keyword_top_k(self, label, prop, query, k):
        return self._from(M.KeywordTopK(label, prop, query, k))

    def hybrid(self, spec: M.Hybrid):
        return self._from(spec)

    def algo(self, algo: M.Algorithm, label: str | None = None):
        return self._from(M.Algo(label, algo))

    def expand(self, direction="Out", edge_type=None):
        return self.then(M.Expand(direction, edge_type))

    def expand_out(self, edge_type=None):
        return self.expand("Out", edge_type)

    def expand_in(self, edge_type=None):
        return self.expand("In", edge_type)

    def expand_both(self, edge_type=None):
        return self.expand("Both", edge_type)

    def expand_var(self, direction, edge_type, low, high):
        return self.then(M.ExpandVar(direction, edge_type, low, high))

    def filter(self, e: M.Expr):
        return self.then(M.Filter(e))

    def frontier_top_k(self, prop, query, k, metric="Cosine"):
        return self.then(M.FrontierTopK(prop, M.Vector(query), metric, k))

    def expand_beam(self, direction, edge_type, prop, query, width, depth, metric="Cosine"):
        return self.then(M.ExpandBeam(direction, edge_type, prop, M.Vector(query), metric, width, depth))

    def distinct(self):
        return self.then(M.Distinct())

    def skip(self, n):
        return self.then(M.Skip(n))

    def limit(self, n):
        return self.then(M.Limit(n))

    def sort_by(self, *keys: M.SortKey):
        return self.then(M.Sort(tuple(keys)))

    def sort_asc(self, e: M.Expr):
        return self.sort_by(M.SortKey(e, False))

    def sort_desc(self, e: M.Expr):
        return self.sort_by(M.SortKey(e, True))

    def sort_by_score(self):
        return self.sort_desc(M.Score())

    def plan(self) -> M.LogicalPlan:
        return self._plan

    # results

    def rows(self, ordered: bool = False) -> DataFrame:
        """id, hops, score of each row; ordered sorts them as the pipeline does."""
        low = Lowering(self.graph, self._plan, ordered)
        st = low.run()
        return (low.sorted(st) if ordered else st.df).select(F.col("head").alias("id"), "hops", "score")

    def ids(self, ordered: bool = True) -> DataFrame:
        return self.rows(ordered).select("id")

    def count(self) -> int:
        low = Lowering(self.graph, self._plan, counted=True)
        df = low.run().df
        return df.agg(F.sum("walks")).first()[0] or 0 if low.counted else df.count()

    def counts(self, **exprs: M.Expr) -> DataFrame:
        """A column for each expression and n, the number of rows with these values. Walks are counted, not listed."""
        low = Lowering(self.graph, self._plan, exprs=tuple(exprs.values()), counted=True)
        st = low.run()
        row = low.row(st)
        df = st.df.select(*(evaluate(e, row).col.alias(f"__c{i}") for i, e in enumerate(exprs.values())), (F.col("walks") if low.counted else F.lit(1).cast("bigint")).alias("n"))
        return df.groupBy(*(F.col(f"__c{i}").alias(n) for i, n in enumerate(exprs))).agg(F.sum("n").alias("n"))

    def select(self, ordered: bool = False, **exprs: M.Expr) -> DataFrame:
        """A column for each expression over the row's node."""
        low = Lowering(self.graph, self._plan, ordered, exprs=tuple(exprs.values()))
        st = low.run()
        row = low.row(st)
        df = low.sorted(st) if ordered else st.df
        return df.select(*(evaluate(e, row).col.alias(n) for n, e in exprs.items()))

    def nodes(self, *props: str, ordered: bool = False) -> DataFrame:
        """id, key, labels, hops, score and the named properties of each row's node."""
        low = Lowering(self.graph, self._plan, ordered)
        st = low.run()
        df = (low.sorted(st) if ordered else st.df).select(F.col("head").alias("id"), "hops", "score", *(st.order if ordered else ()))
        found = self.graph.nodes(st.labels, props, True, True)
        names = [F.col(f"__p{i}").alias(p) for i, p in enumerate(props)]
        out = df.join(found, "id")
        if ordered:
            out = low.sorted(replace(st, df=out))
        return out.select("id", F.col("__key").alias("key"), F.col("__labels").alias("labels"), "hops", "score", *names)

    scored_nodes = nodes

    def subgraph(self) -> tuple[DataFrame, DataFrame]:
        """Distinct nodes (id) and edges (id, src, dst, type) on all trails, heads and the nodes they started from."""
        low = Lowering(self.graph, self._plan, trail=True)
        rows = low.run().df.select("head", F.explode_outer("trail").alias("t"))
        touched = cut(rows.select("head", "t.edge").distinct(), "trails")
        edges = self.graph.edges().join(touched.select(F.col("edge").alias("id")).filter("id is not null").distinct(), "id", "left_semi")
        edges = edges.select("id", "src", "dst", "type")
        ids = touched.select(F.col("head").alias("id")).union(edges.select("src")).union(edges.select("dst")).distinct()
        return ids, edges
