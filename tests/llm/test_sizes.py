import random
from collections import defaultdict

import pytest
from leafwright.llm import mixing, packing
from leafwright.llm.tokencount import TOKENIZERS, VOCABULARY, count_tokens, encoding
from pyspark.sql import functions as F


def test_tokens(spark):
    texts = [None, "", "hello world", "<|endoftext|>", "中文内容", "a" * 40_000]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", count_tokens(F.col("t")).alias("n")).orderBy("i").collect()]
    own = encoding(TOKENIZERS, VOCABULARY)
    assert got == [len(own.encode_ordinary(t or "")) for t in texts] and got[3] > 1


def _one_by_one(sizes, capacity):
    """Containers that best fit in order of decreasing size needs."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_by_hand(seed):
    r = random.Random(seed)
    counts = {s: r.randint(1, 30) for s in r.sample(range(1, 65), 25)}
    rooms, seen = defaultdict(int), defaultdict(set)
    for size, rank, n, first in packing.best_fit(counts, 64):
        for i in range(n):
            assert rank + i not in seen[size]
            seen[size].add(rank + i)
            rooms[first + i] += size
    assert {s: len(x) for s, x in seen.items()} == counts and max(rooms.values()) <= 64
    assert len(rooms) <= 1.02 * _one_by_one([s for s, n in counts.items() for _ in range(n)], 64) + 1


def test_pack(spark):
    r = random.Random(1)
    sizes = [(i, r.choice([64, 3, 64, r.randint(1, 200), 0, None])) for i in range(3000)]
    specs = spark.createDataFrame([(1, 64), (2, 100), (3, 0), (4, None)], "spec_id int, capacity_tokens int")
    df = spark.createDataFrame(sizes, "doc_id long, tokens int").selectExpr("*", "1 AS spec_id", "2 AS rank")
    rows = packing.pack(df, specs).collect()
    for spec, capacity in ((1, 64), (2, 100)):
        own = [x for x in rows if x.spec_id == spec]
        pieces, rooms = defaultdict(list), defaultdict(int)
        for x in own:
            pieces[x.doc_id].append((x.piece_no, x.tokens))
            rooms[x.container_no] += x.tokens
        for i, n in sizes:
            got = sorted(pieces.get(i, []))
            assert sum(t for _, t in got) == (n or 0) and len(got) == -(-(n or 0) // capacity) and all(t == capacity for _, t in got[:-1])
        assert max(rooms.values()) <= capacity and len(rooms) <= 1.02 * _one_by_one([t for p in pieces.values() for _, t in p], capacity) + 1 and set(rooms) == set(range(1, len(rooms) + 1))
    used = packing.use(packing.pack(df, specs), specs).collect()
    assert all(x.free_tokens == {1: 64, 2: 100}[x.spec_id] - x.used_tokens >= 0 for x in used)
    assert sorted(map(str, packing.pack(df.repartition(7), specs).collect())) == sorted(map(str, rows))
    assert packing.pack(df.limit(0), specs).count() == 0 and packing.pack(df, specs.limit(0)).count() == 0


def test_route_spreads_repetition():
    flows, total = mixing.route({("a",): 100, ("a", "b"): 50}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 3}, 200)
    assert total == 200 and flows[("a", "b"), "b"] == 100 and flows[("a",), "a"] == 100
    assert mixing.largest_total({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 4, "c": 2}) in (100, 101, 102)  # quotas are whole tokens
    assert mixing.largest_total({}, {"a": 1.0}, {"a": 1}) == 0


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, r.choice("aaabcd"), f"text {i % 900}", r.randint(1, 40)) for i in range(2000)]
    size = {}
    docs = [(i, s, t, size.setdefault(t, n)) for i, s, t, n in docs] + [(9001, None, "x", 5), (9002, "a", None, 5), (9003, "a", "", 0)]
    target = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "c", 0.2, 3), (2, "a", 0.1, 1), (2, "d", 0.8, 4), (2, "none", 0.1, 2)], "mix_id int, source string, target_share double, max_repeat int")
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens long")
    records, shares = mixing.mix(df, target)
    got, told = records.collect(), {(x.mix_id, x.source): x for x in shares.collect()}
    by_id = {d[0]: d for d in docs}
    limit = {(1, "a"): 1, (1, "b"): 2, (1, "c"): 3, (2, "a"): 1, (2, "d"): 4}
    for x in got:
        assert by_id[x.doc_id][1] == x.source and 1 <= x.copies <= limit[x.mix_id, x.source] and by_id[x.doc_id][3] == x.tokens
    assert len({(x.mix_id, x.source, by_id[x.doc_id][2]) for x in got}) == len(got)
    for (m, s), x in told.items():
        want = x.target_share / (1.0 if m == 1 else 0.9) if s != "none" else 0
        assert x.reached_share == pytest.approx(want, abs=0.02), (m, s)
    assert sorted(map(str, mixing.mix(df.repartition(9), target)[0].collect())) == sorted(map(str, got))
    short = {(x.mix_id, x.source): x.reached_share for x in mixing.mix(df, target, total_tokens=10**7)[1].collect()}
    assert short[2, "none"] == 0 and abs(sum(v for (m, _), v in short.items() if m == 1) - 1) < 1e-9
    assert mixing.mix(df.limit(0), target)[0].count() == 0 and mixing.mix(df, target.limit(0))[0].count() == 0
