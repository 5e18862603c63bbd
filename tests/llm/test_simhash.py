import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timeweave.llm import simhash as S


def test_fingerprint_by_its_definition():
    """Each bit is the weighted majority over the different words of that bit of the word's hash."""
    texts = pa.array(["One two, TWO three-four", "", None, "...", "été été", "z " * 3000])
    rows, prints = S.text_fingerprints(texts)
    assert rows.tolist() == [0, 4, 5]
    single = {w: S.text_fingerprints(pa.array([w]))[1][0] for w in ("one", "two", "three", "four", "z")}
    bits = lambda p: np.unpackbits(p.view(np.uint8), bitorder="little")
    weight = {w: round(32 * np.log2(1 + n)) for w, n in (("one", 1), ("two", 2), ("three", 1), ("four", 1))}
    votes = sum(weight[w] * bits(single[w]).astype(int) for w in weight)
    assert np.array_equal(bits(prints[0]), (2 * votes >= sum(weight.values())).astype(np.uint8)) and np.array_equal(prints[2], single["z"])


def groups(pairs):
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in {y for p in pairs for y in p} if find(x) != x}


def brute(texts: dict, distance: int) -> dict:
    ids = list(texts)
    rows, prints = S.text_fingerprints(pa.array([texts[i] for i in ids]))
    ids = [ids[r] for r in rows]
    h = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int)
    return groups([(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if h[a, b] <= distance])


def test_against_brute_force(spark, docs_of, prose):
    rng = np.random.default_rng(0)
    texts = {}
    for k in range(150):
        words = prose(k, 60 + 3 * k).split()
        texts[len(texts)] = " ".join(words)
        for c in range(int(rng.integers(0, 4))):
            changed = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 20))):
                changed[at] = f"new{k}x{c}y{at}"
            texts[len(texts)] = " ".join(changed)
    want = brute(texts, S.DISTANCE)
    got = {r.doc_id: r.duplicate_of for r in S.near_duplicates(docs_of(list(texts.items()))).collect()}
    assert len(got) > 100 and got == want


def test_on_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()}, S.DISTANCE)
    got = {r.doc_id: r.duplicate_of for r in S.near_duplicates(docs).collect()}
    assert got == want


def flipped(prints, distance, seed):
    """Fingerprints at exactly that distance."""
    rng = np.random.default_rng(seed)
    flips = np.zeros((len(prints), S.BITS), np.uint8)
    for row in flips:
        row[rng.permutation(S.BITS)[:distance]] = 1
    return prints ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)


@pytest.mark.parametrize("n", [1, 1 << 18, 1 << 24, 1 << 28, 1 << 31, 1 << 35])
def test_blocks_are_shared_by_every_pair_at_the_distance(n):
    rng = np.random.default_rng(n % 97)
    a = rng.integers(0, 1 << 63, (3000, 4)).astype(np.uint64)
    blocks = S.blocks_for(n)
    meets = lambda d, m: (S.block_keys(a[:m], blocks) == S.block_keys(flipped(a[:m], d, n % 89), blocks)).any(axis=1)
    assert all(meets(d, m).all() for d, m in ((S.DISTANCE, 3000), (S.DISTANCE - 1, 500), (1, 100)))
    assert meets(128, 500).mean() < 0.01 and blocks.bits >= min(22, np.log2(n) - S.CROWD - 6)


@pytest.mark.parametrize("groups, distance", [(2, 5), (3, 2), (4, 7)])
def test_pigeonhole_by_all_errors(groups, distance):
    """Of 16 bits, all sets of `distance` of them: a block is free of each."""
    from itertools import combinations

    masks = S.pigeonhole(groups, distance, 16).masks
    assert all((~masks[:, list(c)].any(axis=1)).any() for c in combinations(range(16), distance))


def test_crowded_buckets_are_split_and_nothing_is_lost(spark, docs_of, prose):
    """Thousands of near copies beside others: the same groups whatever the size from which buckets are salted, and as by brute force."""
    rng = np.random.default_rng(5)
    base, texts = prose(1, 120).split(), {}
    for k in range(400):
        words = list(base)
        for at in rng.integers(0, len(words), int(rng.integers(0, 14))):
            words[at] = f"w{k}x{at}"
        texts[k] = " ".join(words)
    texts |= {1000 + k: prose(100 + k, 80) for k in range(50)}
    docs = docs_of(list(texts.items()))
    members = lambda df: {frozenset(r.ids) for r in df.groupBy("group").agg(F.collect_set("doc_id").alias("ids")).collect()}
    whole, salted = members(S.classes(docs)), members(S.classes(docs, rows=20))
    assert whole == salted
    want = brute(texts, S.DISTANCE)
    assert {r.doc_id: r.duplicate_of for r in S.near_duplicates(docs).collect()} == want and len(want) > 300


def test_in_part_links_are_complete():
    """Buckets large and small against all pairs of them."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, (6, 4)).astype(np.uint64)
    rows = []
    for key, size in ((1, 2), (2, 9), (3, S.SMALL), (4, 400), (5, 1)):
        prints = np.concatenate([flipped(centre[rng.integers(0, 6, 1)], int(rng.integers(0, 30)), k) for k in range(size)])
        rows += [(key, 1000 * key + i, *p) for i, p in enumerate(prints)]
    records = np.array(rows, np.uint64)
    got = {int(a): int(b) for a, b in S.part_edges(records, S.DISTANCE)}
    pairs = []
    for key in range(1, 6):
        own = records[records[:, 0] == key]
        h = np.bitwise_count(own[:, None, 2:] ^ own[None, :, 2:]).sum(axis=2, dtype=int)
        pairs += [(int(own[a, 1]), int(own[b, 1])) for a, b in np.argwhere(h <= S.DISTANCE) if a > b]
    want = groups(pairs)
    assert {a: b for a, b in got.items() if a != b} == want


def test_nulls_ties_repeats_and_clashes(docs_of, prose):
    a, b = prose(1, 200), prose(2, 200)
    rows = [(4, a), (2, a.upper()), (9, b), (9, b), (None, a), (None, None), (5, None), (6, ""), (7, "!!"), (8, "!!"), (3, a + " extra")]
    docs = docs_of(rows, f0=F.lit("x"), TW_GONE=F.lit(1), node=F.lit(2), part=F.lit(3), said=F.lit(4), group=F.lit(5)).withColumn("a.b", F.lit(1))
    assert {r.doc_id: r.duplicate_of for r in S.near_duplicates(docs).collect()} == {4: 2, 3: 2}
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 9, None, None, 5, 6, 7, 8], key=repr)
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.drop_near_duplicates(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_judged_apart(docs_of, prose):
    """Unrelated texts of one id both stay, also if another document is near one of them; near ones of it are one."""
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (3, c + " more"), (4, ""), (4, "")]
    kept = sorted((r.doc_id, r.text) for r in S.drop_near_duplicates(docs_of(rows)).collect())
    assert [t for i, t in kept if i == 1] == sorted([a, b]) and not [t for i, t in kept if i == 2]
    assert len([t for i, t in kept if i == 3]) == 1 and [t for i, t in kept if i == 4] == ["", ""]


def test_a_large_group_and_a_long_text(docs_of, prose):
    base, long = prose(3, 300), prose(4, 150_000)
    got = {r.doc_id: r.duplicate_of for r in S.near_duplicates(docs_of([(k, f"{base} v{k}") for k in range(1500)] + [(5000, long), (5001, long + " end")])).collect()}
    assert got == {**{k: 0 for k in range(1, 1500)}, 5001: 5000}


def test_chains_are_one_group(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (7, 7)], "u long, v long")
    got = {r.u: r.root for r in S.components(edges).collect() if r.u != r.root}
    assert got == {**{k: 0 for k in range(1, 41)}, 100: 99}
