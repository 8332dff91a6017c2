"""Train, validation and test labels that never part related records.

Method: connected components over shared rows, names and raters; then largest differencing: whole components are
combined into many equal bins by repeatedly merging the two partitions whose extreme bins differ most, and whole bins
go to the splits by target proportion.

Components: records are contracted to their least rater, which leaves a graph among raters; per-task union-find and
alternating large-star and small-star steps then shrink it to stars. Every step aggregates before it shuffles and is
cut by a reliable checkpoint; the centre of a large star is salted where its edges are joined, and is only a hot key of
partial aggregates elsewhere.

Balance: components heavier than a fixed fraction of a bin are balanced one by one (their number is bounded by that
fraction), the light ones in ``LIGHT`` hashed parcels of whole components, so that the driver balances at most
``max(BINS) * HEAVY + LIGHT`` weights at any size.

Defined results: nulls tie nothing; a record without row id, name and rater is a group of its own and goes to a split by a hash
of its place; repeated rows share a group; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markweave.llm.names import essay_name, rater_no
from markweave.session import cut_lineage

#: Ids of groups without a rater start here, above any rater number.
NO_RATER = 1 << 62
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Numbers of equal bins that are tried; the proportions decide.
BINS = (10, 20, 40, 80)
HEAVY, LIGHT = 64, 1024
#: Edges of a node from which on its join is spread, and over how many keys.
HOT, SALTS = 1_000_000, 64


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: each node with the least node of its local tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            parent.setdefault(u, a)
            parent.setdefault(v, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    roots = [root(x) for x in nodes]
    keep = [(x, r) for x, r in zip(nodes, roots) if x != r]
    for k in range(0, len(keep), 100_000):
        part = keep[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["u", "v"])


def _with_least(edges: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """``edges`` joined to their ``u``'s least neighbour ``m``; a node of more than ``hot`` edges is spread over ``SALTS`` keys.

    There are at most as many such nodes as the edges allow, one for every ``hot`` of them; only their names are broadcast.
    """
    heavy = least.where(F.col("k") > hot).select("u", F.lit(True).alias("heavy"))
    salted = edges.join(F.broadcast(heavy), "u", "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("heavy")
    copies = least.select("u", "m", F.explode(F.when(F.col("k") > hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(copies, ["u", "salt"]).select("u", "v", "m")


def _star(edges: DataFrame, hot: int) -> DataFrame:
    """Point every node of a neighbourhood at its least member: the union of a large-star and a small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k")
    large = _with_least(both, least, hot).select(F.greatest("v", "u").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    small = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = small.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    small = _with_least(small, low, hot).select(F.col("v").alias("x"), "m")
    return large.unionByName(small).where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60, hot: int = HOT) -> DataFrame:
    """(``node``, ``root``): the least node of the component of every node that has an edge. ``edges``: ``u``, ``v`` bigint."""
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for _ in range(max_rounds):
        edges = cut_lineage(edges.mapInArrow(_local_forest, "u bigint, v bigint").distinct())
        # Stars: no node has two parents and no parent has a parent.
        state = edges.groupBy("u").agg(F.count("*").alias("k")).agg(F.max("k").alias("k")).first().k
        if state is None or (state == 1 and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = _star(edges, hot)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def tied_groups(wide: DataFrame) -> DataFrame:
    """(``source_row_id``, ``name``, ``rater``, ``group``, ``rows``): the distinct record keys with their group and number of rows.

    ``group`` is the smallest rater number of the group, or an id from ``NO_RATER`` on where the group has no rater; it is
    null for records without any key.
    """
    keys = wide.select(F.col("source_row_id").cast("bigint").alias("source_row_id"), essay_name(F.col("Filename")).alias("name"), rater_no(F.col("rater_id")).alias("rater"))
    keys = cut_lineage(keys.groupBy("source_row_id", "name", "rater").agg(F.count("*").alias("rows")))
    own = lambda kind, c: F.lit(NO_RATER) + F.pmod(F.xxhash64(F.lit(kind), c), F.lit(NO_RATER - 1))
    # An entity is a source row, or a name or a rater where the record has no row id.
    keys = keys.withColumn("entity", F.coalesce(F.when(F.col("source_row_id").isNotNull(), own("row", F.col("source_row_id"))), F.when(F.col("name").isNotNull(), own("name", F.col("name"))), F.col("rater")))
    labelled = keys.where("entity IS NOT NULL").groupBy("entity").agg(F.min("rater").alias("least")).select("entity", F.coalesce("least", "entity").alias("label"))
    known = cut_lineage(keys.join(labelled, "entity", "left"))
    raters = known.where("rater IS NOT NULL").select(F.col("rater").alias("u"), F.col("label").alias("v"))
    names = known.where("name IS NOT NULL").groupBy("name").agg(F.min("label").alias("v"))
    named = known.where("name IS NOT NULL").select("name", F.col("label").alias("u")).distinct().join(names, "name").select("u", "v")
    roots = components(raters.unionByName(named))
    return known.join(roots.withColumnRenamed("node", "label"), "label", "left").select("source_row_id", "name", "rater", F.coalesce("root", "label").alias("group"), "rows")


def group_of_rows(groups: DataFrame) -> DataFrame:
    """(``source_row_id``, ``group_rater``) of every source row whose group has a rater."""
    return groups.where(F.col("source_row_id").isNotNull() & (F.col("group") < NO_RATER)).select("source_row_id", F.col("group").alias("group_rater")).distinct()


def difference_bins(weights: list[int], bins: int) -> list[list[int]]:
    """Largest differencing: indices of ``weights`` in each of ``bins`` nearly equal bins."""
    heap: list[tuple] = []
    for i, w in enumerate(weights):
        parts = [(0, [])] * (bins - 1) + [(w, [i])]
        heap.append((-w, i, parts))
    heapq.heapify(heap)
    serial = len(weights)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: p[0])
        heapq.heappush(heap, (-(merged[-1][0] - merged[0][0]), serial, merged))
        serial += 1
    return [p[1] for p in heap[0][2]] if heap else [[] for _ in range(bins)]


def allocate(weights: list[int], splits=SPLITS, bins=BINS) -> list[str]:
    """The split of each weight: whole bins, heaviest first, to the split that lacks most of its target."""
    total = sum(weights)
    best: tuple[float, list[str]] = (float("inf"), [splits[0][0]] * len(weights))
    for n in bins:
        lacking = {name: share * total for name, share in splits}
        out = [splits[0][0]] * len(weights)
        for b in sorted(difference_bins(weights, n), key=lambda b: -sum(weights[i] for i in b)):
            name = max(lacking, key=lambda k: lacking[k])
            lacking[name] -= sum(weights[i] for i in b)
            for i in b:
                out[i] = name
        best = min(best, (sum(map(abs, lacking.values())), out), key=lambda x: x[0])
    return best[1]


def assign_splits(groups: DataFrame, splits=SPLITS, bins=BINS) -> DataFrame:
    """``groups`` with ``split``: every group whole in one split, by rows in the given proportions as far as groups allow.

    Records without any key belong to no group and have no split here, see ``label_rows``.
    """
    spark = groups.sparkSession
    keyed = groups.where("group IS NOT NULL")
    weights = cut_lineage(keyed.groupBy("group").agg(F.sum("rows").alias("weight")))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    bound = max(1, total // (max(bins) * HEAVY))
    heavy = [(r.group, r.weight) for r in weights.where(F.col("weight") > bound).orderBy("group").toLocalIterator()]  # at most max(bins) * HEAVY
    light = {r.parcel: r.weight for r in weights.where(F.col("weight") <= bound).groupBy(F.pmod(F.xxhash64("group"), F.lit(LIGHT)).cast("int").alias("parcel")).agg(F.sum("weight").alias("weight")).collect()}
    parcels = sorted(light)
    chosen = allocate([w for _, w in heavy] + [light[p] for p in parcels], splits, bins)
    of_heavy = spark.createDataFrame([(g, s) for (g, _), s in zip(heavy, chosen)], "group bigint, heavy_split string")
    of_light = spark.createDataFrame([(p, s) for p, s in zip(parcels, chosen[len(heavy) :])], "parcel int, light_split string")
    out = groups.withColumn("parcel", F.pmod(F.xxhash64("group"), F.lit(LIGHT)).cast("int"))
    out = out.join(F.broadcast(of_heavy), "group", "left").join(F.broadcast(of_light), "parcel", "left")
    return out.select("source_row_id", "name", "rater", "group", "rows", F.when(F.col("group").isNotNull(), F.coalesce("heavy_split", "light_split")).alias("split"))


def label_rows(wide: DataFrame, assigned: DataFrame, splits=SPLITS) -> DataFrame:
    """``wide`` with ``group`` and ``split`` on every row (columns of these names are replaced); a row without any key is a group of its own."""
    rows = wide.drop("group", "split").withColumns({"_row": F.col("source_row_id").cast("bigint"), "_name": essay_name(F.col("Filename")), "_rater": rater_no(F.col("rater_id"))})
    keys = assigned.select(F.col("source_row_id").alias("k_row"), F.col("name").alias("k_name"), F.col("rater").alias("k_rater"), "group", "split").where("group IS NOT NULL")
    same = F.col("_row").eqNullSafe(F.col("k_row")) & F.col("_name").eqNullSafe(F.col("k_name")) & F.col("_rater").eqNullSafe(F.col("k_rater"))
    out = rows.withColumn("_place", F.monotonically_increasing_id()).join(keys, same, "left")
    share = F.pmod(F.xxhash64("_place"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    alone, edge = F.lit(splits[-1][0]), 0.0
    by_hash = None
    for name, part in splits[:-1]:
        edge += part
        by_hash = F.when(share < edge, name) if by_hash is None else by_hash.when(share < edge, name)
    return out.withColumn("split", F.coalesce("split", by_hash.otherwise(alone) if by_hash is not None else alone)).drop("_row", "_name", "_rater", "_place", "k_row", "k_name", "k_rater")


def split_violations(labelled: DataFrame, splits=SPLITS) -> DataFrame:
    """(``check``, ``value``): rows, rows without a label, and source rows, names and raters that stand in more than one split (0 for a right labelling).

    ``off_balance`` is 1 where a split misses its share of the rows by more than the largest group and 2 %.
    """
    keyed = labelled.select(F.col("source_row_id").cast("string").alias("row"), essay_name(F.col("Filename")).alias("name"), rater_no(F.col("rater_id")).cast("string").alias("rater"), "group", "split")
    parted = keyed.select(F.inline(F.array(*(F.struct(F.lit(f"parted_{c}s").alias("check"), F.col(c).alias("key"), "split") for c in ("row", "name", "rater"))))).where("key IS NOT NULL")
    parted = parted.groupBy("check", "key", "split").agg(F.lit(1).alias("one")).groupBy("check", "key").agg(F.count("*").alias("n")).groupBy("check").agg(F.count_if(F.col("n") > 1).alias("value"))
    facts = keyed.agg(F.count("*").alias("rows"), F.count_if(F.col("split").isNull()).alias("unlabelled"), *(F.count_if(F.col("split") == name).alias(name) for name, _ in splits))
    largest = keyed.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    off = sum((F.when(F.abs(F.col(name) - part * F.col("rows")) > F.col("largest") + F.col("rows") / 50, 1).otherwise(0) for name, part in splits), F.lit(0))
    facts = facts.withColumn("one", F.lit(1)).join(largest.withColumn("one", F.lit(1)), "one").select(F.inline(F.array(*(F.struct(F.lit(c).alias("check"), x.cast("bigint").alias("value")) for c, x in (("rows", F.col("rows")), ("unlabelled", F.col("unlabelled")), ("off_balance", F.least(off, F.lit(1))))))))
    return facts.unionByName(parted)
