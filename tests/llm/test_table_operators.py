"""Near-duplicates, mixing, sharding, search, quality, chats and the pipeline against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from swarmframe.llm import catalogue
from swarmframe.llm import chat_format as CF
from swarmframe.llm import exact_topk as TK
from swarmframe.llm import mixing as MX
from swarmframe.llm import near_dedup as ND
from swarmframe.llm import quality_rules as QR
from swarmframe.llm import sharding as SH
from swarmframe.llm.common import rank_within, table

DOCS = "doc_id long, text string, lang string, source string, extra string"
ODD = [
    (1, None, None, None, "x"), (2, "", "en", "a", None), (3, " \n\t ", "en", "a", "y"), (4, "Hello wörld, it's 42!", "en", None, "y"),
    (4, "Hello wörld, it's 42!", "en", None, "y"), (5, "x " * 30_000, "de", "b", "y"), (6, "\x1c\x85   　a\x00b", "en", "b", "y"), (None, "no id", "en", "b", "z"), (None, "no id", "en", "b", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    df = catalogue.queries()[name](spark, data)
    names = sorted(df.columns)
    want = duck(data).sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == names
    key = lambda row: tuple((v is None, v) for v in row)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert got == sorted(want.select(*[f'"{c}"' for c in names]).fetchall(), key=key)


# ---- near-duplicates -----------------------------------------------------------------

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain_components(texts, width):
    sets = {d: plain_set(t, width) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies at many similarities, short texts, chains, one hot group, exact copies."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    texts, doc = {}, 0
    for size in (1, 2, 3, 5, 6, 10, 40, 200):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for _ in range(6):
                new = list(base)
                for _ in range(draw.randint(0, max(1, size // 8))):
                    new[draw.randrange(size)] = word()
                texts[doc] = " ".join(new).upper() if doc % 3 else "\n".join(new)
                doc += 1
    base = [word() for _ in range(120)]
    for k in range(150):
        new = list(base)
        new[draw.randrange(120)] = word()
        texts[doc] = " ".join(new if k % 3 else base)
        doc += 1
    chain = [word() for _ in range(60)]
    for _ in range(25):  # each near the one before, the ends apart
        chain[draw.randrange(60)] = word()
        texts[doc] = " ".join(chain)
        doc += 1
    texts |= {doc: None, doc + 1: "", doc + 2: " \t\n"}
    return texts


@pytest.mark.parametrize("width, region_rows", [(2, 20_000), (5, 20_000), (2, 40)])
def test_components_equal_all_pairs(spark, copies, width, region_rows):
    docs = spark.createDataFrame([(d, t, "q") for d, t in copies.items()], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ND.near_components(docs, width, region_rows=region_rows)[0].collect()}
    assert got == plain_components(copies, width)


def test_dense_regions_are_settled_in_full(spark, monkeypatch):
    """A hot group, and texts near the threshold to few of its members: narrow rounds miss them, the last tests do not."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(100)]
    texts = {}
    for k in range(260):
        new = list(base)
        for _ in range(draw.choice([1, 2, 3, 9, 10, 11, 12])):
            new[draw.randrange(100)] = word()
        texts[k] = " ".join(new)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_components(texts, 2)
    assert len({c for _, c in want.values()}) > 1
    monkeypatch.setattr(ND, "ROUNDS", ((1, 1), (2, 1)))
    monkeypatch.setattr(ND, "BLOCK_ROWS", 16)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ND.near_components(docs, 2)[0].collect()} == want


def test_pairs_over_a_shared_template_are_all_found(spark):
    """Pairs at exactly 0.8 in regions far above the bound: each has no other link, so a region that parts them must not lose it."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrst") for _ in range(9))
    template = [word() for _ in range(75)]
    texts = {}
    for pair in range(400):
        shared = [word() for _ in range(5)]
        for k in range(2):
            texts[2 * pair + k] = " ".join(template + shared + [word() for _ in range(10)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ND.near_components(docs, 1, region_rows=8)[0].collect()}
    assert got == {d: d - d % 2 for d in texts}


def test_components_on_the_table(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    rows = ND.op3_near_dedup(spark, data).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_edges(spark, odd):
    got = ND.near_components(odd, 2)[0].collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 3, 4): 2, (5, 1, 5): 1, (6, 1, 6): 1, (None, 1, None): 2})
    kept = ND.keep_first(odd.withColumn("n", F.lit(1)).withColumn("component_id", F.lit(2)))
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 2})
    assert kept.columns == [*odd.columns, "n", "component_id"]
    assert ND.near_components(odd.limit(0), 2)[0].count() == 0


def test_rows_that_share_an_id(spark):
    """Different texts under one id: each is compared, and none is lost to the other."""
    words = [f"w{k}" for k in range(60)]
    one, two = " ".join(words), " ".join(reversed(words))
    docs = spark.createDataFrame([(5, one), (5, two), (7, one + " x"), (8, two + " y"), (9, "something else")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ND.near_components(docs, 2)[0].collect()} == {(5, 5), (7, 5), (8, 5), (9, 9)}


def test_star_components(spark):
    from swarmframe.llm.common import Scratch

    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(200)] + [(5000, 5000)]
    draw.shuffle(edges)
    got = {r.node: r.root for r in ND.star_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "x").collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    assert got == {x: find(x) for x in root if find(x) != x}


# ---- mixing --------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 0.001, "b": 1000, "c": 1, "d": 333}, {f"s{k}": k + 1 for k in range(40)}])
def test_pfair_windows_and_deviation(weights):
    from fractions import Fraction

    names, sources, phases = MX.exact_schedule(dict.fromkeys(weights, 400), weights)
    total, done = sum(map(Fraction, weights.values())), Counter()
    share = [Fraction(weights[s]) / total for s in names]
    for t, k in enumerate(sources[: phases.count(0)]):
        assert done[k] // share[k] <= t < -(-(done[k] + 1) // share[k])  # released, and not late
        done[k] += 1
        assert all(abs(done[x] - (t + 1) * q) < 1 for x, q in enumerate(share))
    assert Counter(sources) == Counter(dict.fromkeys(range(len(names)), 400))


def plain_mix(blocks, shares):
    """Slot by slot: earliest deadline first, a new start whenever a source runs out."""
    left, slot, out = dict(blocks), 0, {}
    done = Counter()
    while any(left.values()):
        own = {s: shares[s] for s in left if left[s]}
        g = np.gcd.reduce(list(own.values()))
        n = sum(own.values())
        t, since = 0, Counter()
        while True:
            free = [(-(-(since[s] + 1) * n // q), s) for s, q in own.items() if since[s] * n // q <= t]
            _, s = min(free)
            out[(s, done[s])] = slot
            done[s] += 1
            since[s] += 1
            left[s] -= 1
            slot, t = slot + 1, t + 1
            if not left[s]:
                break
        assert g
    return out


def test_slots_equal_a_simulation(spark):
    draw = random.Random(3)
    sizes = {"a": 300, "b": 71, "c": 9, "d": 1, None: 40}
    rows = [(k, s, "clash") for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, _x string")
    for weights in ({"a": 3, "b": 2, "c": 4, "d": 1, None: 1}, None):
        got = MX.mix_slots(docs, weights, block_rows=4).collect()
        assert len(got) == sum(sizes.values())
        blocks = {("null" if s is None else f"={s}"): -(-n // 4) for s, n in sizes.items()}
        given = {("null" if s is None else f"={s}"): (weights.get(s, 0) if weights else MX.default_weight(n)) for s, n in sizes.items()}
        want = plain_mix(blocks, given)
        seen = {("null" if r.source is None else f"={r.source}", r._block): r._slot for r in got}
        assert seen == want
        assert len({(r._slot, r._inside) for r in got}) == len(got)
    mixed = MX.mix_order(docs)
    assert Counter(mixed.collect()) == Counter(docs.collect())


def test_deviation_from_unrounded_weights(spark):
    """Less than one block from the weights themselves, not from rounded ones; far below 1/1024, and with more than 1,024 sources."""
    from fractions import Fraction

    small = {"a": 1.0, "b": 0.37, "c": 0.0001}
    many = {f"s{k:04}": 1.0 + (k % 7) for k in range(1100)}
    for weights, blocks in ((small, {"a": 40_000, "b": 40_000, "c": 40_000}), (many, dict.fromkeys(many, 30))):
        names, sources, phases = MX.exact_schedule(blocks, weights)
        assert len(sources) == sum(blocks.values()) and Counter(sources) == Counter({k: blocks[s] for k, s in enumerate(names)})
        total, done = sum(map(Fraction, weights.values())), Counter()
        first = list(zip(sources, phases, strict=True))[: phases.count(0)]
        for t, (k, _) in enumerate(first):
            done[k] += 1
            for x in range(len(names)) if t % 997 == 0 or t == len(first) - 1 else (k,):
                assert abs(done[x] - (t + 1) * Fraction(weights[names[x]]) / total) < 1
    docs = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(3000)], "doc_id long, source string")
    rows = MX.mix_slots(docs, small, block_rows=1).collect()
    assert sorted(r._slot for r in rows) == list(range(3000)) and Counter(r.source for r in rows) == Counter("abc" * 1000)
    assert sum(r.source == "c" for r in rows if r._slot < 1300) <= 1
    assert all(r._slot >= 2000 for r in MX.mix_slots(docs, {"a": 1, "b": 1}, block_rows=1).collect() if r.source == "c")


def test_long_blocks_are_dealt_in_rounds(spark):
    """With fewer blocks than rows ask for, blocks grow, and short stretches of the order keep the mixture."""
    docs = spark.createDataFrame([(k, "ab"[k % 4 == 0]) for k in range(40_000)], "doc_id long, source string")
    rows = MX.mix_slots(docs, {"a": 3, "b": 1}, blocks_most=200).collect()
    assert len({r._slot for r in rows}) == 200 and Counter(r._slot for r in rows).most_common(1)[0][1] == 200
    order = [r.source for r in MX.mix_order(docs, {"a": 3, "b": 1}, blocks_most=200).collect()]
    assert len(order) == 40_000 and Counter(order) == {"a": 30_000, "b": 10_000}
    for k in range(0, 36_000, 1024):
        assert abs(order[k : k + 1024].count("b") - 256) <= 32


def test_mixing_edges(spark, odd):
    assert Counter(r.doc_id for r in MX.mix_order(odd).collect()) == Counter(d for d, *_ in ODD)
    assert MX.mix_order(odd.limit(0)).count() == 0
    assert MX.mix_order(odd).columns == odd.columns


def test_clashing_names_in_ranks(spark):
    rows = spark.range(50).selectExpr("id AS doc_id", "'s' AS source", "id AS rank", "id AS group_rows", "id AS _slot", "id AS _inside")
    assert MX.mix_slots(rows).columns.count("_slot") == 1 and MX.mix_slots(rows).where("_slot < 4").count() == 50
    assert {r.doc_id: r.rank for r in MX.mix_order(rows).collect()} == {k: k for k in range(50)}


# ---- sharding ------------------------------------------------------------------------


def test_shards_hold_the_mixture(spark, data):
    rows = SH.op5_sharding(spark, data).collect()
    docs = {r.doc_id: r for r in table(spark, data, "documents").collect()}
    assert len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    by_source = defaultdict(Counter)
    for r in rows:
        text = docs[r.doc_id].text or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None)
        by_source[docs[r.doc_id].source][r.shard] += 1
    for counts in by_source.values():
        share = sum(counts.values()) / 16
        assert all(abs(counts[k] - share) < 2 for k in range(16))
    for k in range(16):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


def test_sharding_edges(spark, odd):
    rows = SH.shard_rows(odd, 4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in ODD) and rows[0].shard == 0
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows}[1] == (1, 0)
    assert SH.shard_rows(odd.limit(0)).count() == 0


def test_ranks_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr("swarmframe.llm.common.RANK_BUCKET_ROWS", 64)
    from swarmframe.llm.common import md5_order

    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 50 AS STRING) END AS g").withColumn("o", md5_order(1, F.col("id").cast("string")))
    got = rank_within(rows, "g", "o", ["id"]).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.g].append(r)
    assert sum(map(len, groups.values())) == 3000
    for own in groups.values():
        assert [r.rank for r in sorted(own, key=lambda r: (r.o, r.id))] == list(range(len(own))) and {r.group_rows for r in own} == {len(own)}


# ---- search --------------------------------------------------------------------------


def plain_top(ids, rows, own, query, k):
    scores = [(-int(r @ query), i) for i, r in zip(ids, rows, strict=True) if i != own]
    return [(i, -s) for s, i in sorted(scores)[:k]]


@pytest.mark.parametrize("spread", [2, 30, 10_000, 10**7])
def test_threshold_algorithm_is_exact(spread):
    rng = np.random.default_rng(spread)
    for n, d in ((1, 3), (7, 1), (300, 5), (2000, 8)):
        rows = rng.integers(-spread, spread + 1, (n, d))
        rows[n // 2 :] = rows[: n - n // 2]  # many ties
        if n > 100:
            rows[:, 0] *= 5  # one strong dimension: stops early
        ids = rng.permutation(n) * 3
        kind = TK.exact_number(rows, rows)
        lists = TK.Lists(ids, rows.astype(kind))
        for at in range(0, n, max(1, n // 12)):
            for query in (rows[at], -rows[at], np.zeros(d, int), np.eye(d, dtype=int)[0] * 3):
                want = plain_top(ids, rows, ids[at], query, 20)
                for floor in (-np.inf, want[-1][1] if len(want) == 20 else -np.inf):
                    best, scores, scored = lists.top(int(ids[at]), query.astype(kind), 20, floor)
                    assert list(zip(lists.ids[best].tolist(), scores.astype(int).tolist(), strict=True)) == want and scored <= n


def test_the_bound_stops_the_walk():
    rng = np.random.default_rng(1)
    rows = np.zeros((50_000, 4))
    rows[:, 0] = rng.integers(0, 1_000_000, 50_000)
    lists = TK.Lists(np.arange(50_000), rows)
    best, _, scored = lists.top(-1, np.array([1.0, 0, 0, 0]), 20)
    assert len(best) == 20 and scored < 100
    even = TK.Lists(np.arange(5000), rng.integers(-30, 30, (5000, 16)).astype(float))  # on even dimensions it walks the lists until every row is met
    assert even.top(-1, even.rows[7], 20)[2] > 4000


def test_walks_of_whole_queries(spark):
    """The rows that were scored, by query and block; a floor from the seeds leaves fewer of them and the same result."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(a), float(b)]) for k, (a, b) in enumerate(zip(rng.pareto(1, 9000), rng.random(9000) / 64, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 450 = 0")
    walked = [sum(r.scored for r in TK.top_inner_products(asked, df, seeds=n, candidate_rows=1000, figures=True).collect()) for n in (0, 4096)]
    assert walked[1] <= walked[0] < 20 * 9000 / 2
    assert sorted(map(tuple, TK.top_inner_products(asked, df, seeds=0).collect())) == sorted(map(tuple, TK.top_inner_products(asked, df, candidate_rows=1000).collect()))


def test_topk_edges(spark):
    rows = [(0, [0.5, 1.0]), (20, [0.25, float("nan")]), (3, [1.0, None]), (4, None), (None, [1.0, 1.0]), (5, [float("inf"), 0.0]), (6, [0.5]), (7, [0.5, 1.0]), (7, [0.5, 1.0]), (40, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("id", F.lit("y"))
    got = TK.top_inner_products(df.where("vec_id % 20 = 0"), df, query_rows=1, candidate_rows=2).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 7, 5120), (0, 2, 7, 5120), (0, 3, 40, 6144)][:0] + sorted([(0, 1, 40, 6144), (0, 2, 7, 5120), (0, 3, 7, 5120), (0, 4, 6, 1024), (40, 1, 0, 6144), (40, 2, 7, 6144), (40, 3, 7, 6144), (40, 4, 6, -2048)])
    twice = spark.createDataFrame([(20, [1.0]), (20, [-1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[2:] for r in TK.top_inner_products(twice.where("vec_id = 20"), twice, k=3).orderBy("rank").collect()] == [(2, 12288), (1, 8192), (1, -8192)]
    assert TK.top_inner_products(df.limit(0), df).count() == 0 and TK.top_inner_products(df, df.limit(0)).count() == 0


# ---- quality -------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_counts_equal_their_definitions(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    for r in QR.op9_quality_rules(spark, data).collect():
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.kept or not r.base_failed)
    draw = random.Random(6)
    for _ in range(400):
        text = "".join(draw.choice([" ", "\n", "a", "b ", "a b a b a b a b a ", "#", "\x1c", "é", "　", "\x85", "!\r\n"]) for _ in range(draw.randint(0, 60)))
        assert QR.measure(text)[0] == plain_counts(text), repr(text)


def sample(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(QR.FEATURES)))
    y = (x[:, 2] + 0.3 * x[:, 0] + 0.2 * rng.random(n) < 0.8).astype(float)
    return x, y


def test_forest_learns_and_falls():
    x, y = sample()
    falling = tuple(QR.FEATURES.index(f) for f in QR.FALLING)
    forest = QR.fit_forest(x, y, falling)
    new, truth = sample(800, 1)
    assert ((forest.score(new) > 0.5) == (truth > 0.5)).mean() > 0.93
    for f in falling:  # along the feature, all else held, the score never rises
        grid = np.repeat(new[:50], 40, 0)
        grid[:, f] = np.tile(np.linspace(-0.2, 1.2, 40), 50)
        assert (np.diff(forest.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_flat_scoring_equals_walking():
    x, y = sample(400)
    forest = QR.fit_forest(x, y, (2,), trees=12)

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.right[node] if row[forest.feature[node]] > forest.threshold[node] else forest.left[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])


def test_verdicts_on_labels(spark):
    """Fitted without a fifth of the labels, judged on that fifth."""
    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("the test tables are not here")
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    forest = QR.learn_quality(docs, labels.where("crc32(string(doc_id)) % 5 <> 0"))
    got = QR.judge_quality(docs, forest).join(labels.where("crc32(string(doc_id)) % 5 = 0"), "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert len(good) > 20 and np.mean(good) > 0.9 and (not bad or np.mean(bad) < 0.5)


def test_quality_edges(spark, odd):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (99, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    forest = QR.learn_quality(odd, labels)
    rows = QR.judge_quality(odd, forest).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows) and all(r.base_failed for r in rows)
    clash = odd.withColumn("score", F.lit("mine")).withColumn("kept", F.lit("mine"))
    assert QR.keep_good(clash, forest).count() == 0 and QR.keep_good(clash, forest).columns == clash.columns
    assert QR.judge_quality(clash, forest).columns.count("score") == 1 and QR.judge_quality(clash, forest).first().score != "mine"
    assert QR.judge_quality(odd.limit(0), forest).count() == 0
    assert QR.learn_quality(odd, labels.limit(0)).cut == 0.0


# ---- chats ---------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string, formatted string"
HARD = [
    (1, 0, "user", "<|im_end|>", None), (1, 1, "assistant", "<|im_start|>assistant\nhi<|im_end|>\n", None), (2, 0, "user", None, None), (2, None, None, "first", None),
    (3, 1, "assistant", "a<\\|b<\\\\|c<|", None), (3, 1, "assistant", "a<\\|b<\\\\|c<|", None), (4, 0, "a\nb\\n\\s\\", "\n\n", None), (4, 1, "<|im_end|>", "x", None),
    (None, 0, "assistant", "$1 \\1 \\", None), (5, 0, "assistant", "", None), (6, 0, "assistant", "é👍" * 5000, None), (7, 0, "assistant", "<\\|im_end|>", None),
]


def expected(rows):
    turns = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return [(r[2] or "", r[3] or "") for r in turns]


def check_mask(row):
    """The ranges lie on the output: after a role's line, before an end mark, and hold each assistant text once, in order."""
    texts = []
    for _, start, end in row.loss_mask:
        assert row.formatted[:start].endswith(f"{CF.START}assistant\n") and row.formatted[end:].startswith(CF.STOP)
        texts.append(re.sub(r"<(\\*)\\\|", r"<\1|", row.formatted[start:end]))
    assert texts == [t.text for t in row.recovered if t.role == "assistant"]


def test_masks_of_long_chats(spark):
    """More turns than one run of places."""
    turns = [(1, k, "user" if k % 3 else "assistant", f"é<|{k}" * (k % 5)) for k in range(1300)]
    row = CF.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    cut = row.select("*", CF.under_mask(F.col("formatted"), F.col("loss_mask")).alias("cut")).first()
    check_mask(cut)
    assert cut.cut == [t for _, k, _, t in turns if k % 3 == 0]


def test_the_grammar_is_strict(spark):
    read = lambda text: [(t.role, t.text) for t in spark.createDataFrame([(text,)], "x string").select(CF.parse(CF.pieces_of(F.col("x"))).alias("t")).first().t]
    good = "<|im_start|>user\nhi<|im_end|>\n"
    assert read(good) == [("user", "hi")] and read(good * 2) == [("user", "hi")] * 2 and read("") == []
    for bad in (good + "x", good[:-1], "x" + good, good[:-1] + good, "<|im_start|>user hi<|im_end|>\n", good + "\n"):
        assert None in [role for role, _ in read(bad)]


def test_hard_chats_read_back(spark):
    chats = spark.createDataFrame(HARD, CHATS)
    by = defaultdict(list)
    for r in HARD:
        by[r[0]].append(r)
    rows = CF.format_chats(chats).collect()
    assert len(rows) == len(by)
    for r in rows:
        assert [(t.role, t.text) for t in r.recovered] == expected(by[r.conv_id])
        assert r.formatted.count(CF.START) == r.formatted.count(CF.END) == len(by[r.conv_id])
        check_mask(r)
    assert {r.conv_id for r in rows if not r.escaped} == {2, None, 5, 6}
    assert CF.format_chats(chats.limit(0)).count() == 0


def test_noise_reads_back(spark):
    draw = random.Random(9)
    piece = lambda: "".join(draw.choice(["<", "|", "\\", "<|", "|>", "im_end", CF.START, CF.END, "\n", "n", "s", "x", " "]) for _ in range(draw.randint(0, 8)))
    rows = [(k // 3, k % 3, piece(), piece(), None) for k in range(1500)]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for r in CF.format_chats(spark.createDataFrame(rows, CHATS)).collect():
        assert [(t.role, t.text) for t in r.recovered] == expected(by[r.conv_id])


def test_chat_digests(spark, data):
    by = defaultdict(list)
    for r in table(spark, data, "conversations").collect():
        by[r.conv_id].append((r.conv_id, r.turn, r.role, r.text))
    by[-1] = [(-1, 0, "user", CF.HOSTILE), (-1, 1, "assistant", CF.HOSTILE)]
    rows = CF.op10_chat_format(spark, data).collect()
    assert {r.conv_id for r in rows} == set(by)
    for r in rows:
        turns = expected(by[r.conv_id])
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# ---- the pipeline --------------------------------------------------------------------


def test_stages(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    columns, before = docs.columns, docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = docs.collect()
        if name == "packing":
            assert {r.doc_id for r in now} == {r.doc_id for r in before}
            continue
        assert docs.columns == columns and not Counter(now) - Counter(before)
        if name == "quality rules":
            assert {r.doc_id for r in now} == {r.doc_id for r in QR.op9_quality_rules(spark, data).where("kept").collect()}
        if name == "language ID":
            assert all(any(c.isalpha() for c in r.text) for r in now)
        if name == "near-dedup":
            want = plain_components({r.doc_id: r.text for r in before}, 5)
            assert {r.doc_id for r in now} == {d for d, (_, c) in want.items() if d == c}
        if name == "mixing":
            assert Counter(now) == Counter(before)
        before = now
    whole = corpus_pipeline.run(spark, data)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, docs.collect()))


def test_the_mixture_reaches_the_sequences(spark, tmp_path):
    """Sequences take sources by weight until one runs out, and differ from those packed without the stage."""
    draw = random.Random(13)
    sources = ["a"] * 4000 + ["b"] * 400
    draw.shuffle(sources)
    rows = [(k, " ".join(draw.choice(["some", "words", "of", "text"]) for _ in range(draw.randint(5, 60))), "en", s, None) for k, s in enumerate(sources)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "before"))
    before = spark.read.parquet(str(tmp_path / "before"))
    corpus_pipeline.mixture(spark, before, "").write.parquet(str(tmp_path / "mixed"))
    mixed = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert Counter(map(tuple, mixed)) != Counter(map(tuple, corpus_pipeline.pack(spark, before, "").collect()))
    assert sorted(r.doc_id for r in mixed) == list(range(len(rows)))
    share = 400**MX.ALPHA / (400**MX.ALPHA + 4000**MX.ALPHA)  # 0.17, against 0.09 of the rows
    docs = [sources[r.doc_id] for r in sorted(mixed, key=lambda r: (r.sequence_id, r.offset))]
    for k in range(3):
        assert abs(docs[700 * k : 700 * k + 700].count("b") / 700 - share) < 0.03
    assert docs[3000:].count("b") == 0


def test_every_stage_takes_an_empty_table(spark, data):
    docs = table(spark, data, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0
