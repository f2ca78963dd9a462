from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from rainledger.llm import simhash
from rainledger.llm.columns import table

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int], distance: int) -> dict[int, int]:
    """id -> smallest id reachable, by comparing all pairs."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def as_rows(df):
    return {r[0]: (r[1], r[2]) for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    comps = plain_components(prints, 4)
    assert as_rows(simhash.near_duplicates(docs)) == {i: (f"{p:016x}", comps[i]) for i, p in prints.items()}
    assert len(set(comps.values())) < len(set(prints.values()))


@pytest.mark.parametrize("distance, hot", [(2, False), (3, False), (4, False), (4, True)])
def test_links_of_clouds_and_chains(spark, monkeypatch, distance, hot):
    if hot:  # segments shared by more rows than usual are dealt by whole keys
        monkeypatch.setattr(simhash, "HOT_ROWS", 2)
        monkeypatch.setattr(simhash, "HOT_TIMES", 1)
    rng = random.Random(distance)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        places = rng.sample(range(64), 14)
        for _ in range(25):
            prints.add(center ^ sum(1 << p for p in rng.sample(places, rng.randint(0, 6))))
    for _ in range(15):  # chains of links that are as long as allowed
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            x ^= sum(1 << p for p in rng.sample(range(64), distance))
    prints = {p - (1 << 64) if p >> 63 else p for p in prints}
    nodes = spark.createDataFrame([(p, p) for p in prints], "fp long, comp long")
    close = simhash.components(simhash.one_bit_links(nodes)).withColumnRenamed("node", "fp")
    seen = simhash.stored(nodes.select("fp").join(close, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp")))
    wider = simhash.components(simhash.near_links(seen, distance))
    got = {r.fp: r.to for r in seen.join(wider.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
           .select("fp", F.coalesce("to", "comp").alias("to")).collect()}
    assert got == plain_components({p: p & ((1 << 64) - 1) for p in prints}, distance)


def test_components_of_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(100, 400)]
    star = [(7, i) for i in range(1000, 1300)] + [(1299, 1300), (5, 5)]
    links = spark.createDataFrame(path + star, "a long, b long")
    got = {r.node: r.comp for r in simhash.components(links).collect()}
    assert {got[i] for i in range(100, 401)} == {100}
    assert {got[i] for i in [7, *range(1000, 1301)]} == {7}
    assert 5 not in got


def test_odd_rows(spark):
    rows = [(3, None, "x"), (2, "", "x"), (9, " \n\t", "x"), (4, "one two", "x"), (5, "ONE  two\n", "y"),
            (6, "one two", "x"), (None, "one two", "x"), (4, "one two", "x"),
            (8, "long " * 200_000, "z"), (None, "alone in its group", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    words = f"{plain_fingerprint('one two'):016x}"
    assert [g for g in got if g[1] == "0" * 16] == [(2, "0" * 16, 2), (3, "0" * 16, 2), (9, "0" * 16, 2)]
    assert sorted((g for g in got if g[1] == words), key=str) == [(4, words, 4), (4, words, 4), (5, words, 4), (None, words, 4)]
    assert len(got) == len(rows) and any(g[0] is None and g[2] is None for g in got)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
