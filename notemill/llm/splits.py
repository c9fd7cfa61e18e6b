"""Problem 4: splits that keep related records together.

Groups are connected components, found by hooking roots to smaller neighbours and shortcutting
parent chains, both as joins of written tables.  Splits are dealt by subset sums over the
multiplicities of group sizes, so the totals come as close to the proportions as groups allow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators.indexing import dense_index
from notemill.operators.skew import lookup
from notemill.session import materialize, release

#: Ways in which an author is missing, in lower case.
NO_AUTHOR = ["", "-", "--", "?", ".", "n/a", "na", "nan", "nil", "none", "null", "unknown", "anonymous", "undefined", "[deleted]"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (src string, dst string) as (node, root), root the smallest node.

    Each round hooks every root that has a smaller root next to it to the smallest, then replaces
    hooks by those of their targets until nothing changes; links shrink to distinct pairs of
    different roots.  At the end the hooks of all rounds are followed from the last to the first.
    Rows with a null end are ignored, loops give a component of one, an empty table gives none.  A
    node of any degree is only ever a key of a pre-aggregated minimum, or a heavy key of a join,
    found while the table was written.
    """
    ends = edges.where("src is not null and dst is not null").select("src", "dst")
    nodes = ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct()
    links = materialize(ends.where("src <> dst").distinct(), ("src", "dst"))
    rounds: list[DataFrame] = []
    while True:
        both = links.union(links.select("dst", "src"))
        least = both.groupBy(F.col("src").alias("root")).agg(F.min("dst").alias("_to")).where("_to < root")
        hooks = materialize(least, ("_to",), n=F.count(F.lit(1)))
        if not hooks.counts["n"]:
            release(hooks)
            break
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        moved = True
        while moved:
            up = hooks.select(F.col("root").alias("_to"), F.col("_to").alias("_up"))
            next_up = lookup(hooks.select("root", "_to"), up, "_to", heavy=hooks.heavy["_to"])
            shorter = materialize(next_up.select("root", F.coalesce("_up", "_to").alias("_to"), F.col("_up").isNotNull().alias("_moved")), ("_to",), n=F.count_if("_moved"))
            release(hooks)
            hooks, moved = shorter, shorter.counts["n"] > 0
        jump = hooks.select("root", "_to")
        new = lookup(lookup(links, jump.toDF("src", "_s"), "src", heavy=links.heavy["src"]), jump.toDF("dst", "_d"), "dst", heavy=links.heavy["dst"])
        relabelled = materialize(new.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst")).where("src <> dst").distinct(), ("src", "dst"))
        release(links)
        links = relabelled
        rounds.append(hooks)
    release(links)
    final = None
    for hooks in reversed(rounds):
        own = hooks.select("root", "_to")
        if final is not None:
            after = final.select(F.col("root").alias("_to"), F.col("_to").alias("_end"))
            # written, as a plan that holds the later rounds several times would grow with every round
            own = materialize(lookup(own, after, "_to", heavy=hooks.heavy["_to"]).select("root", F.coalesce("_end", "_to").alias("_to")).unionByName(final))
            release(final)
        final = own
    if final is None:
        return materialize(nodes.select("node", F.col("node").alias("root")))
    out = materialize(nodes.join(final.withColumnRenamed("root", "node"), "node", "left").select("node", F.coalesce("_to", "node").alias("root")))
    for hooks in rounds:
        release(hooks)
    return out


def person_key(name: Column) -> Column:
    """One spelling per person: case folded, blanks squeezed, ``Last, First`` turned; missing is null."""
    squeezed = F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))
    turned = F.regexp_replace(squeezed, r"^([^,]+?) ?, ?([^,]+)$", "$2 $1")
    return F.when(~squeezed.isin(NO_AUTHOR), turned)


def ref_key(ref: Column) -> Column:
    """``account/slug`` in lower case without blanks, outer slashes or a leading address."""
    bare = F.regexp_replace(F.lower(ref), r"(?U)^[\s/]+|[\s/]+$", "")
    bare = F.regexp_replace(bare, r"^(?:https?://)?(?:[^/]+\.[^/]+/)?(?:code/|kernels/)?(?=[^/]+/[^/]+$)", "")
    return F.when(bare.contains("/"), bare)


def notebook_key(notebook: Column) -> Column:
    """The slug that a stored notebook name means: last path part, no ``.ipynb``, no ``_var<i>``, lower case."""
    bare = F.regexp_replace(F.lower(notebook), r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(bare, r"^.*/", "")
    bare = F.regexp_replace(bare, r"\.ipynb$", "")
    return F.regexp_replace(bare, r"_var\d+$", "")


def kernel_groups(kernels: DataFrame, by_slug: bool = False) -> DataFrame:
    """Groups of related kernels as (kernel_ref, slug, group_key), one row per kernel_ref.

    Related by account, author or fork (both ways, and both forked from one kernel, present or
    not).  All rows count.  Rows without kernel_ref are left out; missing authors relate nothing.
    With ``by_slug`` kernels of one slug are related too, as rows that name a slug alone may mean any.
    """
    rows = kernels.select(ref_key(F.col("kernel_ref")).alias("ref"), person_key(F.col("author")).alias("person"), ref_key(F.col("forked_from")).alias("origin")).where("ref is not null")
    account = F.substring_index("ref", "/", 1)
    # all kernels of an account are one group, so accounts stand for them; an origin that is
    # not here stays a node of its own and does not pull in its account
    here = rows.select("ref").distinct()
    own = rows.select("ref", account.alias("account"), "person", "origin").distinct()
    origins = own.where("origin is not null").select("account", "origin").distinct()
    origins = origins.join(here.withColumnRenamed("ref", "origin").withColumn("_here", F.lit(True)), "origin", "left").select(
        F.concat(F.lit("1:"), "account").alias("src"),
        F.when(F.col("_here"), F.concat(F.lit("1:"), F.substring_index("origin", "/", 1))).otherwise(F.concat(F.lit("3:"), "origin")).alias("dst"),
    )
    edges = (
        own.select(F.concat(F.lit("1:"), "account").alias("src"), F.concat(F.lit("1:"), "account").alias("dst"))
        .union(own.where("person is not null").select(F.concat(F.lit("1:"), "account"), F.concat(F.lit("2:"), "person")))
        .union(origins)
        .distinct()
    )
    if by_slug:
        edges = edges.union(own.select(F.concat(F.lit("1:"), "account"), F.concat(F.lit("4:"), F.substring_index("ref", "/", -1))).distinct())
    # accounts sort before persons, absent kernels and slugs, so a group's root is its first account
    roots = components(edges).where("node like '1:%'").select(F.substring("node", 3, 1 << 20).alias("account"), F.substring("root", 3, 1 << 20).alias("group_key"))
    refs = here.select("ref", account.alias("account"), F.substring_index("ref", "/", -1).alias("slug"))
    return refs.join(roots, "account").select(F.col("ref").alias("kernel_ref"), "slug", "group_key")


def group_of_notebooks(notebooks: DataFrame, groups: DataFrame) -> DataFrame:
    """(notebook, group_key) for each distinct stored ``notebook``; a name that means no kernel has none.

    A slug that groups share gets the first group_key, so the choice is stable; ``kernel_groups`` can
    make one group of them.
    """
    names = notebooks.select("notebook").where("notebook is not null").distinct()
    by_slug = groups.groupBy("slug").agg(F.min("group_key").alias("group_key"))
    return names.withColumn("slug", notebook_key(F.col("notebook"))).join(by_slug, "slug").select("notebook", "group_key")


def _exchange(taken: dict[int, int], spare: dict[int, int], missing: int, window: int) -> None:
    """Move groups between ``taken`` and ``spare`` until ``missing`` rows more are taken, or as near as can be.

    Whole groups first, from the largest down; what is left is less than a group and found by a
    bitset over exchanges of real sizes whose sums stay within ``window``.
    """
    source, target = (spare, taken) if missing > 0 else (taken, spare)
    rest = abs(missing)
    for size in sorted(source, reverse=True):
        n = min(source[size], rest // size)
        source[size] -= n
        target[size] = target.get(size, 0) + n
        rest -= n * size
    sign = 1 if missing > 0 else -1
    goal, unit = sign * rest, math.gcd(*spare, *taken) or 1
    nearest = min(goal % unit, -goal % unit)
    if rest <= nearest:
        return
    window = max(window, 2 * rest)
    full = (1 << (2 * window + 1)) - 1
    layers, steps = [1 << window], []

    def distance() -> tuple[int, int]:
        return next((d, v) for d in range(rest + 1) for v in (goal - d, goal + d) if abs(v) <= window and layers[-1] >> (window + v) & 1)

    for size in sorted(s for s in {*spare, *taken} if s <= window):
        for pool, way in ((spare, 1), (taken, -1)):
            count, step = min(pool.get(size, 0), 2 * window // size), 1
            while count:
                n = min(step, count)
                count, step = count - n, step * 2
                last = layers[-1]
                grown = (last | (last << n * size if way > 0 else last >> n * size)) & full
                if grown != last:
                    layers.append(grown)
                    steps.append((size, way * n))
        if layers[-1] >> (window + goal) & 1 or distance()[0] <= nearest:
            break
    at = window + distance()[1]
    for k in range(len(steps) - 1, -1, -1):
        size, n = steps[k]
        if not layers[k] >> at & 1:
            spare[size] = spare.get(size, 0) - n
            taken[size] = taken.get(size, 0) + n
            at -= size * n


def deal_sizes(histogram: dict[int, int], shares: dict[str, float], max_bits: int = 1 << 22) -> dict[str, dict[int, int]]:
    """How many groups of each size go to each split: {split: {size: count}}.

    For each split but the largest, a bitset of reachable subset sums over size multiplicities
    (binary splitting) picks the total nearest to its share.  Sizes are measured in units of
    total/``max_bits``; exact below that total.  Above it the rows that rounding makes too few or too
    many, groups smaller than half a unit among them, are made good by exchanges of real sizes.
    """
    total = sum(s * n for s, n in histogram.items())
    unit = max(1, -(-total // max_bits))
    left = dict(histogram)
    out: dict[str, dict[int, int]] = {}
    main = max(shares, key=lambda k: shares[k])
    for split in [s for s in sorted(shares, key=lambda k: (-shares[k], k)) if s != main]:
        goal = round(total * shares[split])
        items = [(size, count, round(size / unit)) for size, count in sorted(left.items(), reverse=True) if count and round(size / unit)]
        pieces = []
        for size, count, weight in items:
            step = 1
            while count:
                take = min(step, count)
                pieces.append((size, take, weight * take))
                count, step = count - take, step * 2
        limit = (1 << (2 * (goal // unit) + 2)) - 1
        # only every stride-th bitset is kept; those between are made anew on the way back
        stride = max(1, math.isqrt(len(pieces)))
        kept, reach = [], 1
        for k, (_, _, weight) in enumerate(pieces):
            if k % stride == 0:
                kept.append(reach)
            reach = (reach | reach << weight) & limit
        want = goal // unit
        at = next(v for d in range(want + 2) for v in (want - d, want + d) if v >= 0 and reach >> v & 1)
        taken: dict[int, int] = {}
        for first in range((len(kept) - 1) * stride, -1, -stride):
            layers = [kept.pop()]
            for _, _, weight in pieces[first : first + stride]:
                layers.append((layers[-1] | layers[-1] << weight) & limit)
            for k in range(len(layers) - 2, -1, -1):
                size, take, weight = pieces[first + k]
                if not layers[k] >> at & 1:
                    taken[size] = taken.get(size, 0) + take
                    at -= weight
        if unit > 1:
            spare = {s: n - taken.get(s, 0) for s, n in left.items()}
            _exchange(taken, spare, goal - sum(s * n for s, n in taken.items()), max_bits)
        for size, take in taken.items():
            left[size] -= take
        out[split] = {s: n for s, n in taken.items() if n}
    out[main] = {s: n for s, n in left.items() if n}
    return out


def split_groups(sizes: DataFrame, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """Assign groups (group_key, n_rows) to splits as (group_key, n_rows, split).

    Only the histogram of sizes, at most sqrt(2 x rows) numbers, comes to the driver.  Groups of
    equal size are ranked by a seeded hash through dense ids, not in one task.
    Null group_keys are left out; an empty table gives an empty result.
    """
    spark = sizes.sparkSession
    ranked = dense_index(
        sizes.where("group_key is not null").select("group_key", F.col("n_rows").cast("long"), F.xxhash64(F.lit(seed), "group_key").alias("_order")),
        ["n_rows", "_order", "group_key"],
        "_id",
    )
    histogram = ranked.groupBy("n_rows").agg(F.count("*").alias("n"), F.min("_id").alias("first")).collect()
    plan = deal_sizes({r["n_rows"]: r["n"] for r in histogram}, shares)
    first = {r["n_rows"]: r["first"] for r in histogram}
    bounds = []
    for split in sorted(plan):
        for size, count in plan[split].items():
            bounds.append((size, first[size], first[size] + count, split))
            first[size] += count
    # as many rows as there are sizes and splits: at most 3 sqrt(2 x rows); groups of one size can be most of all
    table = F.broadcast(spark.createDataFrame(bounds, "n_rows long, _from long, _to long, split string"))
    return (
        ranked.join(table, "n_rows").where("_id >= _from and _id < _to").select("group_key", "n_rows", "split")
    )


def related_rows(domain_results: DataFrame, complexity: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows to be split: each stored notebook name of both tables with its number of rows and group."""
    names = (
        domain_results.select("notebook", F.lit("prediction").alias("kind"))
        .unionAll(complexity.select(F.col("base_notebook"), F.lit("features")))
        .where("notebook is not null")
        .groupBy("kind", "notebook")
        .agg(F.count("*").alias("n_rows"))
    )
    by_slug = groups.groupBy("slug").agg(F.min("group_key").alias("group_key"))
    keyed = names.withColumn("slug", notebook_key(F.col("notebook"))).join(by_slug, "slug", "left")
    # a name that means no kernel is a group of its own
    return keyed.select("kind", "notebook", "n_rows", F.coalesce("group_key", F.concat(F.lit("?"), "slug")).alias("group_key"))
