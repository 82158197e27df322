"""Mixing sources to target weights.

Equal texts may stand in several sources, so tokens are counted by membership pattern: the set of a mix's sources that
hold a text. A min-cost flow routes the tokens of the patterns to the quotas of the sources; the k-th use of a
pattern costs k, so repetition is spread as evenly as the quotas allow. The network has one node a pattern and source
of a mix and is solved on the driver. The texts to take are then chosen in a seeded order by distributed running sums.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwright.session import broadcast_if_small, cut

SEED = 17
#: Texts of one part of the seeded order, about; parts are summed up apart, and their number follows from the texts' count.
BUCKET_TEXTS = 20_000
#: Patterns of a mix that are routed on the driver, and planned runs that are broadcast (some 100 bytes each).
MOST_PATTERNS, PLAN_BROADCAST_ROWS = 100_000, 200_000


class _Flow:
    """Min-cost flow by successive shortest paths, for networks of a few hundred edges."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, start: int, end: int) -> int:
        total = 0
        while True:
            far, via = [float("inf")] * len(self.out), [-1] * len(self.out)
            far[start], again = 0, [start]
            while again:
                following = []
                for a in again:
                    for e in self.out[a]:
                        if self.room[e] > 0 and far[a] + self.cost[e] < far[self.to[e]]:
                            far[self.to[e]], via[self.to[e]] = far[a] + self.cost[e], e
                            following.append(self.to[e])
                again = list(dict.fromkeys(following))
            if far[end] == float("inf"):
                return total
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            most = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= most
                self.room[e ^ 1] += most
            total += most


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[dict[tuple[tuple[str, ...], str], int], int]:
    """Tokens that each source takes of each pattern, and their sum, for quotas of ``shares`` times ``total``."""
    keys, names = sorted(patterns), sorted(shares)
    flow = _Flow(2 + len(keys) + len(names))
    place = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    edges = {}
    for i, p in enumerate(keys):
        for k in range(1, max(repeats[s] for s in p) + 1):
            flow.edge(0, 2 + i, patterns[p], k)
        for s in p:
            edges[p, s] = (flow.edge(2 + i, place[s], patterns[p] * repeats[s]), patterns[p] * repeats[s])
    for s in names:
        flow.edge(place[s], 1, int(shares[s] * total + 1e-6))
    reached = flow.run(0, 1)
    return {k: room - flow.room[e] for k, (e, room) in edges.items()}, reached


def largest_total(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total of which every source that has tokens can hold its share."""
    held = {s for p in patterns for s in p if patterns[p] > 0}
    own = {s: x for s, x in shares.items() if s in held and x > 0}
    if not own:
        return 0
    mine = {p: w for p, w in patterns.items() if w > 0}
    low, high = 0, int(sum(w * max(repeats[s] for s in p) for p, w in mine.items()) / sum(own.values())) + 1
    while low < high:
        middle = (low + high + 1) // 2
        wanted = sum(int(x * middle + 1e-6) for x in own.values())
        if route(mine, own, repeats, middle)[1] >= wanted:
            low = middle
        else:
            high = middle - 1
    return low


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Two tables: (mix_id, source, doc_id, tokens, copies) of the chosen records, and (mix_id, source, target_share, reached_share,
    tokens, documents, max_repeat) of the shares reached.

    ``documents`` has doc_id, source, text and tokens; ``targets`` mix_id, source, target_share and max_repeat (a small table). A
    mix is as large as ``total_tokens`` or, if that isn't given, the largest of which every source that has
    tokens can hold its share; with a given total a source too small falls short. A source without tokens
    reaches share 0. No text is used by a source more than ``max_repeat`` times. Chosen records may miss
    a quota by half a text. Equal texts of a source count once, under the least doc_id. Null texts, sources, and texts
    without tokens are never chosen. The choice depends on the texts and the seed only.
    """
    rows = [r for r in targets.distinct().collect() if r.mix_id is not None and r.source is not None]
    mixes: dict[int, dict[str, tuple[float, int]]] = defaultdict(dict)
    for r in rows:
        mixes[r.mix_id][r.source] = (float(r.target_share or 0), int(r.max_repeat or 0))
    names = sorted({r.source for r in rows})
    spark = documents.sparkSession
    own = documents.where(F.col("source").isin(names) & (F.col("tokens") > 0)).select("doc_id", "source", F.md5("text").alias("_text"), F.col("tokens").cast("long").alias("tokens"))
    held = own.groupBy("_text", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = held.groupBy("_text").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("_in"))  # at most one entry a source
    texts = cut(texts.withColumn("_order", F.xxhash64("_text", F.lit(seed + 1))))
    buckets = -(-texts.count() // BUCKET_TEXTS) or 1
    texts = texts.withColumn("_bucket", F.pmod(F.xxhash64("_text", F.lit(seed)), F.lit(buckets)))
    by_pattern = cut(texts.groupBy(F.transform("_in", lambda x: x["source"]).alias("p")).agg(F.sum("tokens").alias("w")))  # at most two to the number of named sources
    if (n := by_pattern.count()) > MOST_PATTERNS:
        raise ValueError(f"{n} membership patterns are more than a flow can route ({MOST_PATTERNS}); name fewer sources at once")
    counted = by_pattern.collect()
    plan = []
    for k, wanted in sorted(mixes.items()):
        usable = {s: v for s, v in wanted.items() if v[1] > 0}
        patterns: dict[tuple[str, ...], int] = defaultdict(int)
        for r in counted:
            if p := tuple(s for s in r.p if s in usable):
                patterns[p] += int(r.w)
        shares, repeats = {s: v[0] for s, v in usable.items()}, {s: v[1] for s, v in usable.items()}
        total = largest_total(patterns, shares, repeats) if total_tokens is None else total_tokens
        flows, _ = route(dict(patterns), shares, repeats, total)
        at: dict[tuple[str, ...], int] = defaultdict(int)
        for (p, s), f in sorted(flows.items()):
            if f > 0:  # the uses of a pattern lie one after the other on a line that passes its texts again and again
                plan.append((int(k), "\x1f".join(p), s, at[p], at[p] + f, patterns[p]))
                at[p] += f
    planned = spark.createDataFrame(plan, "mix_id long, _p string, source string, _from long, _to long, _w long")
    usable_of = {int(k): [s for s, v in w.items() if v[1] > 0] for k, w in sorted(mixes.items())}
    sources = F.transform("_in", lambda x: x["source"])
    members = [F.struct(F.lit(k).cast("long").alias("mix_id"), F.array_join(F.array_intersect(sources, F.array(*map(F.lit, usable))), "\x1f").alias("_p")) for k, usable in usable_of.items() if usable]
    chosen = texts.select("*", F.explode(F.array(*members)).alias("_m")).select("_text", "tokens", "_in", "_bucket", "_order", "_m.*").where(F.col("_p") != "") if members else None
    report = spark.createDataFrame([(int(r.mix_id), r.source, float(r.target_share or 0), int(r.max_repeat or 0)) for r in rows], "mix_id long, source string, target_share double, max_repeat int")
    if chosen is None:
        empty = spark.createDataFrame([], "mix_id long, source string, doc_id long, tokens long, copies long")
        return empty, report.selectExpr("mix_id", "source", "target_share", "0D AS reached_share", "0L AS tokens", "0L AS documents", "max_repeat")
    parts = chosen.groupBy("mix_id", "_p", "_bucket").agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy("mix_id", "_p").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("mix_id", "_p", "_bucket").orderBy("_order", "_text").rowsBetween(Window.unboundedPreceding, -1)
    line = chosen.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, ["mix_id", "_p", "_bucket"])
    line = line.withColumn("_at", F.col("_offset") + F.col("_inside")).join(broadcast_if_small(planned, PLAN_BROADCAST_ROWS), ["mix_id", "_p"])
    middle = F.col("_at") + F.floor(F.col("tokens") / 2)  # a text at the end of a quota goes in if at least half of it does
    passes = lambda end: F.floor((F.col(end) - 1 - middle) / F.col("_w"))
    line = line.withColumn("copies", (passes("_to") - passes("_from")).cast("long")).where(F.col("copies") > 0)
    doc = F.filter("_in", lambda x: x["source"] == F.col("source"))[0]["doc_id"]
    records = cut(line.select("mix_id", "source", doc.alias("doc_id"), "tokens", "copies"))
    sums = records.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"))
    all_of = sums.groupBy("mix_id").agg(F.sum("tokens").alias("_all"))
    told = report.join(F.broadcast(sums), ["mix_id", "source"], "left").join(F.broadcast(all_of), "mix_id", "left")  # a row a target
    told = told.select("mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "max_repeat")
    return records, told
