"""Problem 8: mixing sources to target weights.

Texts are aggregated by membership pattern (the set of sources that hold the text).  A min-cost
flow routes the patterns' tokens to the quotas of the sources; the r-th use of a text costs r - 1,
so repetition is spread evenly and comes last.  A source's fate follows from its own tokens and cap;
what other sources take of texts that it shares shows as its shortfall.  Documents are then selected in a seeded order, by
positions on the token axis of their pattern, so that no text exceeds its cap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators.spread import spread
from notemill.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 1 << 16
MAX_PATTERNS = 20_000  # sets of sources that hold a text together; more are refused


def source_key(source: Column) -> Column:
    """One spelling per source: lower case, trimmed, ``_`` as ``-``; empty is null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(source), r"(?U)^\s+|\s+$", ""), "_", "-")
    return F.when(bare != "", bare)


def count_tokens(texts: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Add ``n_tokens`` of the column ``text`` under a rank file; the file travels by broadcast."""
    with open(tokenizer, "rb") as f:
        ranks = texts.sparkSession.sparkContext.broadcast(f.read())
    columns = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.value.splitlines() if line)}
        encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            out = batch[columns].copy()
            out["n_tokens"] = [len(encoding.encode_ordinary(t)) for t in batch["text"]]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInPandas(run, schema + ", n_tokens long")


@dataclass
class Arc:
    to: int
    capacity: float
    cost: float
    back: int
    flow: float = 0.0


def min_cost_flow(n: int, arcs: list[tuple[int, int, float, float]], source: int, sink: int) -> list[float]:
    """Flow on each arc (from, to, capacity, cost) of a maximum flow of least cost.

    Successive shortest paths by Bellman-Ford; every augmentation saturates an arc, and the graph
    has as many nodes as there are sources and membership patterns.
    """
    graph: list[list[Arc]] = [[] for _ in range(n)]
    handles = []
    for a, b, capacity, cost in arcs:
        graph[a].append(Arc(b, capacity, cost, len(graph[b])))
        graph[b].append(Arc(a, 0.0, -cost, len(graph[a]) - 1))
        handles.append((a, len(graph[a]) - 1))
    while True:
        best = [float("inf")] * n
        via: list[tuple[int, int] | None] = [None] * n
        best[source], queue, queued = 0.0, [source], {source}
        while queue:
            u = queue.pop(0)
            queued.discard(u)
            for k, arc in enumerate(graph[u]):
                if arc.capacity - arc.flow > 1e-6 and best[u] + arc.cost < best[arc.to] - 1e-9:
                    best[arc.to], via[arc.to] = best[u] + arc.cost, (u, k)
                    if arc.to not in queued:
                        queue.append(arc.to)
                        queued.add(arc.to)
        if via[sink] is None:
            break
        room, at = float("inf"), sink
        while at != source:
            u, k = via[at]
            room, at = min(room, graph[u][k].capacity - graph[u][k].flow), u
        at = sink
        while at != source:
            u, k = via[at]
            graph[u][k].flow += room
            graph[at][graph[u][k].back].flow -= room
            at = u
    return [graph[a][k].flow for a, k in handles]


def plan_mix(supply: dict[tuple[str, ...], int], quotas: dict[str, float], caps: dict[str, int]) -> dict[tuple[tuple[str, ...], str], float]:
    """Tokens that each pattern gives to each source: {(pattern, source): tokens}.

    A text may serve any source of its pattern, each at most as often as its cap allows, and is used
    at most as often in all as the highest of these caps.
    """
    patterns, names = sorted(supply), sorted(quotas)
    arcs, keys = [], []
    first, sink = 1 + len(patterns), 1 + len(patterns) + len(names)
    for p, pattern in enumerate(patterns):
        own = [s for s in pattern if s in quotas]
        if not own:
            continue
        for use in range(max(caps[s] for s in own)):
            arcs.append((0, 1 + p, float(supply[pattern]), float(use)))
            keys.append(None)
        for s in own:
            arcs.append((1 + p, first + names.index(s), float(supply[pattern]) * caps[s], 0.0))
            keys.append((pattern, s))
    for k, s in enumerate(names):
        arcs.append((first + k, sink, quotas[s], 0.0))
        keys.append(None)
    flows = min_cost_flow(sink + 1, arcs, 0, sink)
    return {key: flow for key, flow in zip(keys, flows, strict=True) if key is not None and flow > 1e-6}


def prepare(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per distinct text with a source: (doc_id, pattern, n_docs, n_tokens), materialised.

    doc_id is the least of the text's documents; pattern the sorted set of its sources.
    """
    docs = documents.select("doc_id", "text", source_key(F.col("source")).alias("source")).where("source is not null and text is not null and text <> ''")
    keyed = docs.withColumn("_key", F.sha2("text", 256))
    texts = keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"), F.sort_array(F.collect_set("source")).alias("pattern"))
    whole = texts.join(keyed.select("_key", "doc_id", "text").dropDuplicates(["_key", "doc_id"]), ["_key", "doc_id"]).select("doc_id", "pattern", "n_docs", "text")
    return materialize(count_tokens(spread(whole), tokenizer))


def mix_plan(texts: DataFrame, targets: DataFrame) -> tuple[dict, dict[str, dict]]:
    """The flow and, per source, quota, own tokens, delivered tokens, fate and shortfall.

    Only sums per membership pattern come to the driver: more than ``MAX_PATTERNS`` are refused.
    """
    rows = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"]).collect()
    caps = {r["source"]: max(1, int(r["max_repeats"] or 1)) for r in rows}
    sums = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources that share texts")
    total = sum(r["total"] for r in sums)
    quotas = {r["source"]: total * float(r["target_share"] or 0.0) for r in rows}
    supply = {tuple(r["pattern"]): r["n"] for r in sums if r["n"]}
    flow = plan_mix(supply, quotas, caps)
    report = {}
    for s, quota in quotas.items():
        delivered = float(sum(f for (p, q), f in flow.items() if q == s))
        own = sum(n for p, n in supply.items() if s in p)
        report[s] = {"quota": float(quota), "own": own, "delivered": delivered, "fate": fate(own, quota, caps[s]), "shortfall": max(0.0, quota - delivered), "total": total}
    return flow, report


def fate(own: int, quota: float, cap: int) -> str:
    """``sample`` if a source's own tokens suffice for its quota, ``repeat`` if they do when used up to ``cap`` times, else ``short``."""
    return "short" if not own or own * cap < quota else "repeat" if own < quota else "sample"


def select_documents(texts: DataFrame, flow: dict, seed: int = 17) -> DataFrame:
    """The mix: (doc_id, source, n_uses, n_tokens), one row per text and source it is used for.

    The texts of a pattern lie on its token axis in a seeded order; each source takes whole rounds
    of the axis and one stretch, and the stretches of different sources follow each other.  The
    position of a text comes from sums over 65,536 hash buckets, so no task orders a pattern.
    """
    spark = texts.sparkSession
    order = F.xxhash64(F.lit(seed), "doc_id")
    placed = texts.withColumn("_o", order).withColumn("_b", F.shiftrightunsigned("_o", 48))
    buckets = placed.groupBy("pattern", "_b").agg(F.sum("n_tokens").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("pattern").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    bases = buckets.select("pattern", "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.sum("n_tokens").over(Window.partitionBy("pattern", "_b").orderBy("_o", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    at = placed.withColumn("_in", within - F.col("n_tokens") / 2.0).join(bases, ["pattern", "_b"]).withColumn("_at", F.col("_base") + F.col("_in"))
    supply = {tuple(r["pattern"]): r["n"] for r in texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    stretches = []
    for pattern in sorted({p for p, _ in flow}):
        n, start = float(supply[pattern]), 0.0
        for s in sorted(s for p, s in flow if p == pattern):
            rounds, rest = divmod(flow[pattern, s], n)
            if rest > n * (1 - 1e-9):
                rounds, rest = rounds + 1, 0.0
            stretches.append((list(pattern), s, int(rounds), start, start + rest, n))
            start = (start + rest) % n
    table = spark.createDataFrame(stretches, "pattern array<string>, source string, _rounds long, _from double, _to double, _n double")
    inside = (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")) | (F.col("_at") + F.col("_n") < F.col("_to"))
    return (
        at.join(F.broadcast(table), "pattern")
        .withColumn("n_uses", F.col("_rounds") + inside.cast("long"))
        .where("n_uses > 0")
        .select("doc_id", "source", "n_uses", "n_tokens")
    )


def mix_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of ``documents`` (doc_id, text, source) under ``targets`` (source, target_share, max_repeats).

    The mix is as large as all documents with a source together, in tokens.  The report has one
    row per target: source, quota, own_tokens, planned_tokens, shortfall, fate; ``shortfall`` is what
    the flow could not deliver, be it for want of own tokens or as other sources took shared texts.
    Documents without source or text are left out; repeated rows are one text; sources without a
    target count for the size and are not used; a target without documents is ``short``; an empty
    document table gives an empty mix.
    """
    texts = prepare(documents, targets, tokenizer)
    flow, report = mix_plan(texts, targets)
    spark = documents.sparkSession
    rows = [(s, r["quota"], r["own"], r["delivered"], r["shortfall"], r["fate"]) for s, r in sorted(report.items())]
    plan = spark.createDataFrame(rows, "source string, quota double, own_tokens long, planned_tokens double, shortfall double, fate string")
    mix = select_documents(texts, flow)
    return mix, plan


def mix_report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the tokens really used and their share of the mix."""
    used = mix.groupBy("source").agg(F.sum(F.col("n_uses") * F.col("n_tokens")).alias("used_tokens"), F.max("n_uses").alias("most_uses"))
    total = used.agg(F.sum("used_tokens").alias("mix_tokens"))
    return (
        plan.join(used, "source", "left")
        .crossJoin(F.broadcast(total))
        .select("source", "quota", "own_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), (F.coalesce("used_tokens", F.lit(0)) / F.col("mix_tokens")).alias("actual_share"), F.col("shortfall"), "fate")
    )
