import collections
import math
import os
import random
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakv.llm import _sieve, jaccard, katz, packing, sharding
from stratakv.llm.components import components
from tests.llm.conftest import EDGES, documents

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return WORD.findall((t or "").translate(LOWER))


# ------------------------------------------------------------------ op5


def shingles(t, k):
    w = tokens(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, t):
    sets = [shingles(x, k) for _, x in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared * t.denominator >= t.numerator * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    smallest = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(sets[i]), smallest[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed, n=140):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    shared = [word() for _ in range(25)]
    bases = [[word() for _ in range(rng.choice([3, 6, 12, 40, 80]))] for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            text = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
        elif kind < 0.7:
            text = [word() for _ in range(rng.randint(5, 60))] + shared
        else:
            text = [word() for _ in range(rng.randint(0, 60))]
        rows.append((i * 7 % 1000, " ".join(text).upper() if rng.random() < 0.1 else "\n".join(text)))
    return rows


@pytest.mark.parametrize(("k", "t", "how"), [(4, Fraction(85, 100), {}), (5, Fraction(4, 5), {}), (3, Fraction(1, 2), {"longest": 3}), (2, Fraction(6, 10), {"most": 1})])
def test_join_equals_brute_force(spark, k, t, how):
    rows = near_copies(k)
    got = jaccard.self_join(documents(spark, rows), k, t, **how)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(rows, k, t)


def test_join_through_a_full_sieve(spark, monkeypatch):
    """With so few bits that every text passes, the exact joins alone decide."""
    monkeypatch.setattr(_sieve, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(_sieve, "SPARSE", 1)
    monkeypatch.setattr(jaccard, "STEP", 7)
    rows = near_copies(5)
    got = jaccard.self_join(documents(spark, rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(rows, 5, Fraction(4, 5))


def test_sieve(spark):
    keys = [(x * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for x in range(1, 3000)]
    held = _sieve.sieve(spark.createDataFrame([(x,) for x in keys[:1000]], "h long"))
    ok = _sieve.passes(held.value, np.array(keys))
    assert ok[:1000].all() and ok[1000:].mean() < 0.05
    assert not _sieve.passes(_sieve.sieve(spark.createDataFrame([], "h long")).value, np.array(keys)).any()


def proposed(spark, rows, most, longest=jaccard.LIST):
    """Pairs that the two walks propose to a join that asks for ``most`` matches at most."""
    seen, real = [], jaccard._linked
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "_linked", lambda texts, k, limit, pairs, classes: seen.append(pairs.count()) or real(texts, k, limit, pairs, classes))
        got = jaccard.self_join(documents(spark, rows), most=most, longest=longest)
        result = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)
    return sum(seen), result


def test_more_matches_propose_fewer_pairs(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passages = [[word() for _ in range(9)] for _ in range(8)]
    rows = near_copies(3) + [(2000 + i, " ".join([word() for _ in range(4)] + sum(rng.sample(passages, 3), []) + [word() for _ in range(3)])) for i in range(150)]
    one, same = proposed(spark, rows, 1)
    several, got = proposed(spark, rows, 4)
    assert got == same == brute_components(rows, 5, Fraction(4, 5))
    assert several < one


def test_bitmaps_never_count_too_many():
    rng = np.random.default_rng(8)
    for n in (1, 5, 64, 65, 300, 1000):
        x = rng.integers(0, 2**64, n, np.uint64)
        for size, shared in ((n, n), (n, n * 9 // 10), (n * 2, n // 2), (n, 0)):
            y = np.concatenate((x[:shared], rng.integers(0, 2**64, size - shared, np.uint64)))
            a, b = jaccard.bitmaps(np.concatenate((x, y)), np.array([0, n, n + size]))
            differ = n + size - 2 * shared
            assert differ / 8 <= jaccard.differ_at_least(a, b) == jaccard.differ_at_least(b, a) <= differ


def test_pairs_of_a_long_list_stay_in_bounds():
    """All pairs of 20,000 texts of one list are walked a step at a time."""
    n = jaccard.LIST
    zero = np.zeros(n, np.int64)
    lists = jaccard.Lists(np.arange(n).astype(np.uint64), np.arange(n).astype(np.uint64), zero + 100, zero + 1, zero, zero + 2, np.array([0, n]))
    tracemalloc.start()
    pairs = 0
    for i, j in jaccard.across(lists, jaccard.Threshold(Fraction(4, 5))):
        assert len(i) <= jaccard.STEP + n
        pairs += len(i)
        if pairs > 2e7:
            break
    assert tracemalloc.get_traced_memory()[1] < 5e8
    tracemalloc.stop()


def test_join_at_the_edges(spark, edges, nothing):
    got = jaccard.self_join(edges, 4, Fraction(85, 100))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(EDGES, 4, Fraction(85, 100))
    assert jaccard.self_join(nothing).count() == 0


@pytest.mark.parametrize("bits", [1 << 30, 1 << 10])
def test_one_of_each(spark, edges, nothing, monkeypatch, bits):
    monkeypatch.setattr(_sieve, "MOST_BITS", bits)
    rows = near_copies(9) + [(5000, "again " * 9), (5000, "again " * 9), (None, "no id here at all " * 3), (None, "no id here at all " * 3), (2, "some words that nobody else has written"), (2, "some words that nobody else has written")]
    docs = documents(spark, rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute_components(rows, 5, Fraction(4, 5))
    wordless = sum(not n for _, n, _ in want)
    named = {c for _, n, c in want if n and c is not None}
    nameless = 1
    assert kept.count() == wordless + len(named) + nameless
    assert {r.doc_id for r in kept.collect() if tokens(r.text) and r.doc_id is not None} == named
    assert jaccard.one_of_each(nothing).count() == 0
    assert jaccard.one_of_each(edges).count() == len(EDGES) - 2


def test_prefix_lemma():
    """Sets that link share m of the first |x| - a + m items under any order."""
    rng = random.Random(1)
    limit = jaccard.Threshold(Fraction(85, 100))
    for _ in range(3000):
        x = set(rng.sample(range(60), rng.randint(5, 50)))
        y = set(rng.sample(sorted(x), rng.randint(len(x) * 8 // 10, len(x)))) | set(rng.sample(range(60, 70), rng.randint(0, 3)))
        shared = len(x & y)
        if limit.links(shared, len(x), len(y)):
            a = limit.overlap(len(x), len(y))
            assert shared >= a
            for m in range(1, min(4, a) + 1):
                assert len(set(sorted(x)[: len(x) - a + m]) & set(sorted(y)[: len(y) - a + m])) >= m


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# ------------------------------------------------------------------ op7


def brute_katz(rows):
    docs = [(i, tokens(t) + ["</s>"]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, ws), h in zip(docs, held):
        for a, b in zip(["<s>", *ws], ws):
            if not h:
                one[b] += 1
                two[a, b] += 1
                before[a] += 1
    n = sum(one.values())
    d1, d2 = katz.discounts(collections.Counter(one.values())), katz.discounts(collections.Counter(two.values()))
    d = lambda table, c: table[min(c, katz.K + 1) - 1]
    p = {w: d(d1, c) * c / n for w, c in one.items()}
    unknown = 1 - sum(p.values())
    after = collections.defaultdict(dict)
    for (a, b), c in two.items():
        after[a][b] = d(d2, c) * c / before[a]
    weight = {a: (1 - sum(s.values())) / (1 - sum(p[w] for w in s)) for a, s in after.items()}
    for a, s in list(after.items())[:40]:
        assert abs(sum(s.values()) + weight[a] * (unknown + sum(v for w, v in p.items() if w not in s)) - 1) < 1e-9
    out = []
    for (i, ws), h in zip(docs, held):
        total = sum(math.log10(after[a][b]) if b in after.get(a, {}) else math.log10(weight.get(a, 1) * p.get(b, unknown)) for a, b in zip(["<s>", *ws], ws))
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (len(one) + 1))) for w in ws)
        out.append((i, h, len(ws), sum(one[w] > 0 for w in ws), n, round(base, 6), round(total, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [12_000_000, 900])
def test_katz_equals_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(katz, "RANGE_BYTES", ranges)
    rng = random.Random(6)
    vocabulary = [f"w{int(1 / (rng.random() + 0.003))}" for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(150)] + EDGES[:8]
    got = katz.score(documents(spark, rows))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect()), key=repr) == brute_katz(rows)


def test_katz_at_the_edges(spark, edges, nothing):
    got = katz.score(edges).collect()
    assert len(got) == len(EDGES) and all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)
    assert katz.score(nothing).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = katz.score(documents(spark, [(held, "a b")])).collect()[0]
    assert alone.held_out and alone.n_known == 0 and alone.score == 0 and alone.train_tokens == 0


def test_discounts():
    d = katz.discounts({1: 1000, 2: 400, 3: 200, 4: 120, 5: 80, 6: 55})
    assert all(0 < x < 1 for x in d) and d[-1] == katz.LARGE
    assert list(katz.discounts({})[:2]) == [0.5, 0.75]


# ------------------------------------------------------------------ op9

needs_vocabulary = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/word_bpe_49k.json"), reason="the vocabulary is absent")
TRICKY = ["it's a don't “test” … Ünï's ≮ a<|endoftext|>b .'s —. x'LL İx ﬁ", "naïve café CAFÉ Straße", "a\x1cb c　d 12345 9,876.5 £5", "#!$%&'s 've", "x" * 300]


@needs_vocabulary
def test_pieces_are_the_tokens(spark, edges, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = EDGES + [(100 + i, x) for i, x in enumerate(TRICKY)]
    got = packing.pieces(documents(spark, rows), packing.default_tokenizer(), 64, with_ids=True).collect()
    by_crc = collections.Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            by_crc[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == by_crc
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert packing.pack_documents(nothing).count() == 0


def check_packing(rows, capacity):
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for own in at.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= capacity
    return len(at)


@needs_vocabulary
@pytest.mark.parametrize("lot", [20_000, 40])
def test_packing_is_gapless(spark, lot):
    rng = random.Random(8)
    rows = [(i, " ".join("abc" for _ in range(int(rng.expovariate(1 / 60))))) for i in range(300)]
    got = packing.pack_documents(documents(spark, rows), capacity=128, lot=lot).collect()
    used = check_packing(got, 128)
    need = -(-sum(r.length for r in got) // 128)
    assert need <= used <= need * (1.03 if lot > 300 else 1.2)


def test_sum_of_squares_is_the_rule():
    """Each item goes where the sum of squared counts by gap grows least, by definition."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 21, 200)
    bins, places = packing.sum_of_squares(lengths, 20)
    gaps: dict[int, int] = {}
    for length, b, place in zip(lengths.tolist(), bins.tolist(), places.tolist()):
        count = collections.Counter(g for g in gaps.values() if g)
        cost = {}
        for g in {*count, 20}:
            if g >= length:
                after = count.copy()
                if g < 20 or count[20]:
                    after[g] -= 1
                if g > length:
                    after[g - length] += 1
                cost[g] = sum(v * v for v in after.values())
        gap = gaps.get(b, 20)
        assert place == 20 - gap and cost[gap] == min(cost.values())
        gaps[b] = gap - length


# ------------------------------------------------------------------ op10


def check_shards(rows, total, shards):
    counts = collections.Counter(r.shard for r in rows)
    assert len(rows) == total and set(counts) <= set(range(shards))
    assert max(counts.values()) - min([counts.get(s, 0) for s in range(shards)]) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_shards(spark, edges, nothing):
    rng = random.Random(4)
    rows = [(i, f"text {rng.randint(0, 500)}") for i in range(600)] + [(1000 + i, "hot") for i in range(300)]
    got = sharding.shard(documents(spark, rows), 8).collect()
    check_shards(got, 900, 8)
    text = dict(rows)
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    at = collections.defaultdict(collections.Counter)
    for r in got:
        at[text[r.doc_id]][r.shard] += 1
    groups = [c for t, c in at.items() if sum(c.values()) > 1 and t != "hot"]
    assert sum(len(c) == 1 for c in groups) >= 0.97 * len(groups)
    check_shards(sharding.shard(edges).collect(), len(EDGES), 16)
    assert sharding.shard(nothing).count() == 0


def test_all_linked(spark):
    rows = [(i, f"t{i // 3}") for i in range(96)]
    check_shards(sharding.shard(documents(spark, rows), 5).collect(), 96, 5)
    check_shards(sharding.shard(documents(spark, [(i, "one") for i in range(50)]), 4).collect(), 50, 4)


def test_large_groups_stay_together(spark):
    """Whole where a shard has room, else in as few shards as quotas allow."""
    sizes = {"whole": 200, "two": 240, "cut": 610}
    texts = [t for t, n in sizes.items() for _ in range(n)] + [f"pair {i // 2}" for i in range(300)] + [f"single {i}" for i in range(650)]
    random.Random(6).shuffle(texts)
    got = sharding.shard(documents(spark, list(enumerate(texts))), 8).collect()
    check_shards(got, 2000, 8)
    at = collections.defaultdict(collections.Counter)
    for r in got:
        at[texts[r.doc_id]][r.shard] += 1
    assert {t: len(at[t]) for t in sizes} == {"whole": 1, "two": 1, "cut": 3}
    pairs = [c for t, c in at.items() if t.startswith("pair")]
    assert sum(len(c) == 1 for c in pairs) >= 0.97 * len(pairs)


@pytest.mark.parametrize(("upper", "size", "buckets"), [(1024, 20_000, 1), (2, 20, 1), (3, 50, 40)])
def test_numbers_are_gapless(spark, monkeypatch, upper, size, buckets):
    """With few and many buckets, in one run and in several."""
    monkeypatch.setattr(sharding, "UPPER", upper)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", size)
    df = spark.range(900).withColumn("g", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 7))
    got = sharding.indexed(df, "g", "id", 900, "nth", buckets).collect()
    for g, n in collections.Counter(r.g for r in got).items():
        assert sorted(r.nth for r in got if r.g == g) == list(range(n))
    assert len(got) == 900


def test_pieces():
    assert sharding.pieces([6, 6, 6], [10, 10]) == [[(0, 6)], [(1, 6)], [(0, 4), (1, 2)]]
    assert sharding.pieces([25], [10, 10, 10]) == [[(0, 10), (1, 10), (2, 5)]]
    rng = random.Random(2)
    for _ in range(300):
        quota = [rng.randint(0, 9) for _ in range(5)]
        sizes, left = [], sum(quota)
        while left:
            sizes.append(rng.randint(1, min(left, 12)))
            left -= sizes[-1]
        got = sharding.pieces(sizes, quota)
        assert [sum(n for _, n in x) for x in got] == sizes and all(n > 0 for x in got for _, n in x)
        assert [sum(n for x in got for b, n in x if b == k) for k in range(5)] == quota
        rows = rng.randint(0, sum(quota))
        dealt = sharding.shares(rows, quota)
        assert sum(dealt) == rows and all(0 <= a <= q for a, q in zip(dealt, quota))


def test_grants_hold():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(2, 6)
        wishes = [[0 if a == b else rng.randint(0, 9) for b in range(n)] for a in range(n)]
        free = [rng.randint(0, 5) for _ in range(n)]
        flow = sharding.granted(wishes, free)
        for b in range(n):
            assert sum(flow[a][b] for a in range(n)) - sum(flow[b]) <= free[b]
            assert all(0 <= flow[a][b] <= wishes[a][b] for a in range(n))


def test_sharding_is_native(spark, edges):
    plan = sharding._described(edges)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "crc32" in plan
    assert sharding.shard(edges).where(F.col("shard").isNull()).count() == 0
