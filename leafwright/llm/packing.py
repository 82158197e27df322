"""Filling containers of fixed capacity with texts.

Bulk-synchronous best fit. Sizes are whole tokens, so items and gaps fall into at most ``capacity`` classes; items are
range-sorted into size classes and ranked inside them, which is distributed, and the containers of a gap class are
a set of number ranges. A round takes the items of the largest remaining size and sweeps the gap classes
upwards from that size, each time to the next class that holds containers (the successor); items and containers of two
matched classes are paired by rank, so no two items claim one gap; the gaps shrink and the next round
begins. Items without a gap open containers. A round moves counts only, whatever the number of texts, so the
rounds run on the driver over at most ``capacity`` classes a specification, and the pairs are joined back to the items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.session import cut, lookup

#: Items of a size class that are ranked in one bucket, about; the number of buckets follows from the class's count.
BUCKET_ITEMS = 20_000
#: Size classes up to this many are broadcast (a few longs each), more are joined by class and salt.
CLASSES_BROADCAST_ROWS = 500_000
#: Ranks of a size class that are joined to the runs together, so that a hot size is spread.
RANKS = 4096

PLAN = T.StructType([T.StructField("spec_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("first_rank", T.LongType()), T.StructField("n", T.LongType()), T.StructField("first_container", T.LongType())])


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, n, first container) of runs of items, numbered from 0, put into runs of containers.

    Best fit in order of decreasing size: an item goes where the least room is left over.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of containers [from, to)
    order: list[int] = []
    plan, opened = [], 0

    def put(gap: int, run: tuple[int, int]) -> None:
        if gap <= 0:
            return
        if not gaps[gap]:
            insort(order, gap)
        gaps[gap].append(run)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(order, size)
            if at == len(order):  # no gap is wide enough: open containers, each for as many items as fit
                n = -(-left // max(1, capacity // size)) if size <= capacity else left
                put(capacity, (opened, opened + n))
                opened += n
                continue
            gap = order[at]
            a, b = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
            n = min(left, b - a)
            if n < b - a:
                put(gap, (a + n, b))
            plan.append((size, rank, n, a))
            put(gap - size, (a, a + n))
            left -= n
            rank += n
    return plan


def _ranked(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``, from 0, inside (spec_id, size). A class is ranked in as many buckets as its count asks for; their offsets come from counts."""
    classes = items.groupBy("spec_id", "size").agg(F.count("*").alias("_n")).withColumn("_buckets", F.ceil(F.col("_n") / BUCKET_ITEMS).cast("int")).drop("_n")
    spread = lookup(items, classes, ["spec_id", "size"], CLASSES_BROADCAST_ROWS, ["doc_id", "piece_no"])
    spread = spread.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("_buckets")).cast("int")).drop("_buckets")
    inside = Window.partitionBy("spec_id", "size", "_bucket").orderBy("doc_id", "piece_no")
    spread = spread.withColumn("_inside", F.row_number().over(inside) - 1)
    offsets = spread.groupBy("spec_id", "size", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("spec_id", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return spread.join(offsets, ["spec_id", "size", "_bucket"]).withColumn("rank", (F.col("_offset") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_offset")


def pack(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, doc_id, piece_no, tokens, container_no) for every text and specification.

    ``sizes`` has doc_id (unique) and tokens, ``specs`` has spec_id and capacity_tokens (a small, fixed table). A text longer than
    the container is divided into pieces of full capacity and a rest; any other text has one piece, numbered 1.
    Texts of no tokens and of null size need no container and are left out, as are specifications without a
    positive capacity. Containers are numbered from 1 per specification. The result is the same for any partitioning.
    """
    wanted = {int(r.spec_id): int(r.capacity_tokens) for r in specs.select("spec_id", "capacity_tokens").distinct().collect() if r.spec_id is not None and (r.capacity_tokens or 0) > 0}
    spark = sizes.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(wanted.items())])) if wanted else None
    if each is None:
        return spark.createDataFrame([], "spec_id long, doc_id long, piece_no int, tokens long, container_no long")
    items = sizes.where(F.col("tokens") > 0).select("doc_id", F.col("tokens").cast("long").alias("tokens"), each.alias("_s")).select("doc_id", "tokens", "_s.*")
    piece = F.explode(F.sequence(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")).cast("int")))
    items = items.select("spec_id", "doc_id", "tokens", "capacity", piece.alias("piece_no"))
    items = items.select("spec_id", "doc_id", "piece_no", F.least("capacity", F.col("tokens") - F.col("capacity") * (F.col("piece_no") - 1)).alias("size"))
    items = cut(items)
    counted: dict[int, dict[int, int]] = defaultdict(dict)
    for r in items.groupBy("spec_id", "size").count().toLocalIterator():  # at most the sum of the capacities
        counted[r.spec_id][r["size"]] = r["count"]
    plan = [(k, *run) for k, sizes_of in counted.items() for run in best_fit(sizes_of, wanted[k])]
    block = lambda c: F.floor(c / RANKS).cast("long")
    runs = spark.createDataFrame(plan, PLAN).withColumn("_block", F.explode(F.sequence(block(F.col("first_rank")), block(F.col("first_rank") + F.col("n") - 1))))
    placed = _ranked(items).withColumn("_block", block(F.col("rank"))).join(runs, ["spec_id", "size", "_block"])
    placed = placed.where((F.col("first_rank") <= F.col("rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    return placed.select("spec_id", "doc_id", "piece_no", F.col("size").alias("tokens"), (F.col("first_container") + F.col("rank") - F.col("first_rank") + 1).alias("container_no"))


def use(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, container_no, n_pieces, used_tokens, free_tokens) of each container of :func:`pack`."""
    filled = packed.groupBy("spec_id", "container_no").agg(F.count("*").alias("n_pieces"), F.sum("tokens").alias("used_tokens"))
    capacity = specs.select(F.col("spec_id").cast("long").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("_c")).distinct()
    return filled.join(capacity, "spec_id").select("spec_id", "container_no", "n_pieces", "used_tokens", (F.col("_c") - F.col("used_tokens")).alias("free_tokens"))


def fill(used: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, containers, pieces, tokens, fill, fewest): how full the containers of :func:`use` are; ``fewest`` is what the tokens need at least."""
    capacity = specs.select(F.col("spec_id").cast("long").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct()
    told = used.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("n_pieces").alias("pieces"), F.sum("used_tokens").alias("tokens"))
    share = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return told.join(capacity, "spec_id").select("spec_id", "capacity_tokens", "containers", "pieces", "tokens", share.alias("fill"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"))
