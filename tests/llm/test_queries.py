"""The registered queries: against SQL where there is some, and the pipeline against its stages by brute force."""

import pytest

import __spark_entry__ as entry
from timeweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(name, spark, sf_dir, same_rows):
    same_rows(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.queries()) <= set(names) and "pipeline" in names


def test_pipeline_against_its_stages(spark, sf_dir):
    """Every stage's rows follow from its input: nothing is lost but what the stage decides to leave out."""
    import corpus_pipeline as cp
    from timeweave.llm import mixing, packing, quality, secrets, simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = [f for _, f in cp.STAGES]
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "simhash near-dedup", "secret scan", "mixing to target weights", "best-fit packing"]

    good = stages[0](spark, docs, sf_dir).cache()
    scores = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    assert good.columns == columns and ids(good) == sorted(i for i, k in scores.items() if k)

    once = stages[1](spark, good, sf_dir).cache()
    dropped = {r.doc_id for r in simhash.near_duplicates(good).collect()}
    assert once.columns == columns and ids(once) == sorted(set(ids(good)) - dropped)

    clean = stages[2](spark, once, sf_dir).cache()
    assert clean.columns == columns and ids(clean) == ids(once)
    held = {r.doc_id: r.text for r in once.collect()}
    found = {}
    for r in secrets.find_secrets(once).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end))
    for r in clean.collect():
        want = held[r.doc_id]
        for a, b in sorted(found.get(r.doc_id, []), reverse=True):
            want = want[:a] + secrets.MASK + want[b:]
        assert r.text == want and (r.doc_id not in found or r.n_chars == len(want))
    assert secrets.find_secrets(clean).count() == 0

    mixed = stages[3](spark, clean, sf_dir).cache()
    rates = {r.source: r.rate for r in mixing.source_rates(clean).collect()}
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in clean.collect():
        assert copies.get(r.doc_id, 0) in (int(rates[r.source]), int(rates[r.source]) + 1)
    assert mixed.columns == columns

    bins = stages[4](spark, mixed, sf_dir).collect()
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert sum(r.length for r in bins) == words
    fill = {}
    for r in bins:
        fill[r.shard, r.bin] = fill.get((r.shard, r.bin), 0) + r.length
    assert max(fill.values()) <= packing.CAPACITY
    assert sorted(tuple(r) for r in cp.run(spark, sf_dir).collect()) == sorted(tuple(r) for r in bins)
