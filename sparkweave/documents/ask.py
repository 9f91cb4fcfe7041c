"""Questions over a graph: a loop around a chat model that looks up edge types and entities and proposes plans.

The model answers with JSON objects: {"parts": [...]} splits the question, {"find_edge": text} and {"find_entity": text}
look things up by similarity, {"plan": {...}} is a logical plan to run. The last turn asks for a plan alone. Plans that
fail are told to the model as text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators.lowering import Query, vector_top_k
from ..operators.reads import union_subgraphs
from ..plans import model as M
from ..sources.graph import Graph
from .providers import Chat, Embedder, json_in

# Hits of the look-ups, turns, and rows of a plan that sets no limit.
EDGE_HITS, ENTITY_HITS, TURNS, PLAN_LIMIT = 10, 5, 20, 100


@dataclass
class Answer:
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    plans: list[M.LogicalPlan] = field(default_factory=list)
    turns: int = 0
    failures: list[str] = field(default_factory=list)


def find_edge(graph: Graph, text: str, embed: Embedder, k: int = EDGE_HITS) -> list[str]:
    """The edge types (with the labels they join) nearest to a text. There are few types: a row each."""
    rows = catalog.connections(graph).collect()
    told = sorted({f"(:{r['src_label']})-[:{r['type']}]->(:{r['dst_label']})" for r in rows})
    q = embed(text)
    score = lambda t: sum(a * b for a, b in zip(embed(t), q, strict=True))
    return sorted(told, key=lambda t: (-score(t), t))[:k]


def find_entity(graph: Graph, text: str, embed: Embedder, k: int = ENTITY_HITS) -> list[str]:
    """Keys of the nodes whose embedding is nearest to a text."""
    hits = vector_top_k(graph, None, "embedding", embed(text), "Cosine", k)
    named = hits.join(graph.nodes(key=True), "id").orderBy("distance", "id").select(F.coalesce("__key", F.col("id").cast("string")).alias("k"))
    return [r["k"] for r in named.collect()]


def ask(graph: Graph, question: str, chat: Chat, embed: Embedder, max_turns: int = TURNS) -> Answer:
    """Run the loop; the answer is the union of the plans' subgraphs."""
    out = Answer()
    system = "Answer with one JSON object: parts, find_edge, find_entity or plan.\n" + catalog.summary(graph)
    heard, wanted, looked = [f"Question: {question}"], 1, 0
    found = []
    while out.turns < max_turns:
        last = out.turns == max_turns - 1
        out.turns += 1
        reply = json_in(chat(system, "\n".join([*heard, "Give a plan now."] if last else heard)))
        if "parts" in reply:
            wanted = max(1, len(reply["parts"]))
            heard.append(f"{wanted} parts: look up an edge for each, then give {wanted} plans.")
        elif "find_edge" in reply and not last:
            looked += 1
            heard.append("edges: " + "; ".join(find_edge(graph, str(reply["find_edge"]), embed)))
        elif "find_entity" in reply and not last:
            heard.append("entities: " + "; ".join(find_entity(graph, str(reply["find_entity"]), embed)))
        elif "plan" in reply:
            if looked < wanted and not last:
                heard.append("look up the edges first")
                continue
            try:
                plan = limited(M.LogicalPlan.from_json(reply["plan"]))
                found.append(Query(graph, plan).subgraph())
                out.plans.append(plan)
                heard.append(f"plan {len(out.plans)} of {wanted} is in")
            except Exception as e:  # told to the model, which may repair the plan
                out.failures.append(str(e))
                heard.append(f"that plan failed: {str(e)[:300]}")
            if len(out.plans) >= wanted:
                break
        else:
            heard.append("that was no such object")
    if found:
        out.nodes, out.edges = union_subgraphs(found)
    return out


def limited(plan: M.LogicalPlan, n: int = PLAN_LIMIT) -> M.LogicalPlan:
    """The plan, with a limit if it ends without one."""
    if plan.steps and isinstance(plan.steps[-1], M.Limit):
        return plan
    return M.LogicalPlan(plan.source, (*plan.steps, M.Limit(n)))
