from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rainledger.llm import exact_dedup, language_id, quality_rules, sharding, site_quality, url_rules
from rainledger.llm.columns import table
from rainledger.llm.queries import op1_language_id, op5_sharding, op10_site_quality
from rainledger.llm.simhash import without_near_duplicates

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SPACE = "[\x20\x09-\x0D]+"


# Exact deduplication

def plain_duplicates(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE, " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def duplicate_rows():
    rng = random.Random(3)
    long = "".join(rng.choice("ab \n") for _ in range(700))
    rows = [(i, rng.choice(["a", "a\n b", "a \tb ", "", None, "  ", long, long + "x", "x" + long, long * 2])) for i in range(60)]
    return rows + [(None, long), (None, "a"), (7, "a"), (7, "a"), (99, "é" * 50), (98, "é" * 50)]


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_duplicates_at_any_block_size(spark, block):
    rows = duplicate_rows()
    docs = spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, name string")
    got = exact_dedup.exact_duplicates(docs, block=block).collect()
    assert sorted(map(tuple, got), key=str) == plain_duplicates(rows)


def test_duplicates_when_fingerprints_collide(spark):
    rows = duplicate_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs, block=16, hashes=lambda b: [F.length(b), F.lit(1)]).collect()
    assert sorted(map(tuple, got), key=str) == plain_duplicates(rows)


def test_without_duplicates_leaves_one_row_of_repeated_ones(spark, tmp_path):
    spark.createDataFrame(duplicate_rows(), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    kept = exact_dedup.without_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()
    texts = [re.sub(SPACE, " ", r.text or "") for r in kept]
    assert len(texts) == len(set(texts)) == len({x[4] for x in plain_duplicates(duplicate_rows())})
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_row_keys_stay_when_the_table_is_cut_differently(spark, tmp_path):
    rows = [(i, f"text {i // 2}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    size = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(size)
    try:
        for f in (exact_dedup.without_duplicates, without_near_duplicates):
            kept = f(spark.read.parquet(str(tmp_path / "t")))
            spark.conf.set(size, "300")
            assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 400, 2))
            spark.conf.set(size, old)
    finally:
        spark.conf.set(size, old)


# Language

def test_language_of_rows_that_were_not_learned(spark):
    rows = op1_language_id(spark, MEDIUM).join(table(spark, MEDIUM, "documents"), "doc_id").collect()
    new = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in new) / len(new) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(i, "the cat and the dog are in the house", "en") for i in range(9)] + [
        (i, "der Hund und die Katze sind im Haus", "de") for i in range(9, 18)] + [
        (18, None, "en"), (19, "", None), (20, "123 !?", "en"), (21, "the dog and the cat", None), (None, "die Katze und der Hund", "xx"),
        (21, "the dog and the cat", None), (22, "der Hund " * 30_000, None)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, lang string, score string")
    got = language_id.identify(docs)
    assert got.columns == ["doc_id", "text", "lang", "score", "lang_pred", "_score", "accepted"]
    found = [(r.doc_id, r.lang_pred, r.accepted) for r in got.collect() if r.doc_id is None or r.doc_id > 17]
    assert Counter(found) == Counter([(18, "und", False), (19, "und", False), (20, "und", False), (21, "en", True), (21, "en", True),
                                      (None, "de", True), (22, "de", True)])
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_training_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("Text"), "id", F.repeat(F.lit("word "), 500)).alias("text"),
                                    F.lit("en").alias("lang"))
    sample = language_id.training_sample(docs, "text", "lang", "doc_id")
    whole = [t for _, t in sample if len(t) > 2500]
    assert len(whole) >= len(sample) - 1 and sum(len(t) for _, t in sample) == language_id.SAMPLE_CHARS
    same = docs.withColumn("text", F.lit("all of it"))
    assert language_id.training_sample(same, "text", "lang", "doc_id") == [("en", "all of it")]


def test_training_sample_is_not_only_openings(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("h"), 600), F.lit(" "), "id", F.repeat(F.lit(" word"), 1000)).alias("text"),
                                   F.lit("en").alias("lang"))
    sample = [t for _, t in language_id.training_sample(docs, "text", "lang", "doc_id")]
    assert sum(t.count("h") for t in sample) < 0.15 * sum(map(len, sample))


def test_more_languages_than_the_bound(spark):
    words = {k: (chr(97 + k // 26) + chr(97 + k % 26)) * 6 for k in range(300)}
    rows = [(3 * k + i, f"{w} and {w}{w[::-1]}", f"l{k:03d}") for k, w in words.items() for i in range(3)]
    rows += [(2000 + i, f"more words of the common language {i}", "common") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="not learned: l"):
        sample = language_id.training_sample(docs, "text", "lang", "doc_id", max_languages=9)
    assert len({label for label, _ in sample}) == 9 and any(label == "common" for label, _ in sample)
    found = language_id.identify(docs, max_languages=301)
    assert found.filter("lang_pred = lang").count() > 0.5 * len(rows)


def plain_sizes(text, known):
    """The language with the smallest size, by compressing afresh."""
    import zstandard

    data = b" ".join("".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).encode().split())
    sizes = []
    for label, content in known.items():
        packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                          write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append((sum(len(packer.compress(data[i:i + 4096])) for i in range(0, len(data), 4096)), label))
    best, second = sorted(sizes)[:2]
    return best[1], 1 - best[0] / second[0]


def test_language_against_plain_sizes(spark):
    docs = table(spark, SMALL, "documents")
    known = language_id.dictionaries(language_id.training_sample(docs, "text", "lang", "doc_id"))
    for r in language_id.identify(docs).collect():
        if r.text and any(map(str.isalpha, r.text)):
            label, score = plain_sizes(r.text, known)
            assert r.lang_pred == label and r.score == pytest.approx(score, abs=2e-3), r.doc_id


def test_every_kind_of_bad_row_gets_a_rule(spark):
    """Twelve kinds of bad rows that no two have a rule in common, and noise that no precise rule covers."""
    rng = random.Random(11)
    names = [f"s{i}" for i in range(12)]
    rows = []
    for i in range(7200):
        values = [rng.random() for _ in names]
        kind = rng.randrange(24)
        if kind < 12:
            values[kind] = 2 + rng.random()
        rows.append((*values, int(kind < 12 or rng.random() < 0.02), rng.randrange(3), kind))
    fields = ", ".join(f"{n} double" for n in names)
    labelled = quality_rules.stored(spark.createDataFrame(rows, f"{fields}, bad int, fold int, kind int"))
    rules = quality_rules.learn(labelled, "bad", "fold", names)
    hit = F.lit(False)
    for rule in rules:
        hit = hit | quality_rules._matches(rule, {n: F.col(n) for n in names})
    kinds = {r.kind: r.part for r in labelled.groupBy("kind").agg(F.avg(hit.cast("int")).alias("part")).collect()}
    assert all(kinds[k] > 0.95 for k in range(12)) and all(kinds[k] < 0.1 for k in range(12, 24))


# URL rules

def plain_url(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("parts", [1, 7])
def test_urls_against_all_rules(spark, parts):
    rng = random.Random(parts)
    hosts = [".".join(rng.choice(["a", "b", "aa", "c", ""]) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/b#x", "/é/x", "/a?b=/c", "a"]
    urls = [rng.choice(["http://", "HTTPS://", "", "x://y://"]) + rng.choice(hosts).upper() + rng.choice(paths) for _ in range(600)]
    urls += [None, "", "://", "http://a" + "/a" * 3000] + ["http://a.b/a/b"] * 200
    rules = {(rng.choice(hosts), rng.choice(["", "/", "/a", "/a/", "/a/b", "/é"])): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items() if h]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules), parts=parts).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: plain_url(u, rules) for i, u in enumerate(urls)}


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (None, None), (1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in url_rules.judge_urls(pages, none).collect()} == {(None, "allow")}
    rules = url_rules.rule_table(spark, [("b", "/", "block"), ("b", "/", "allow")])
    assert sorted((r.verdict for r in url_rules.judge_urls(pages, rules).collect())) == ["allow", "block", "block"]
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert [r.page_id for r in url_rules.kept_pages(pages, rules).collect()] == [None]


# Quality rules

def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, repeated = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            repeated.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated),
            n < 20 or 100 * len(repeated) > 30 * n)


def count_rows(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice(["a ", "b ", "c\n", "\n", "d#\t", "é|", "\x0b", "\u00a0", "\x1f "]) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    made += [None, "", "x " * 5000, " ".join(f"w{i % 9}" for i in range(40)), ("one two three four five six seven eight " * 2).strip()]
    real = [r.text for r in table(spark, SMALL, "documents").select("text").collect()]
    return made + real


def test_counts_of_whole_texts(spark):
    texts = count_rows(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: tuple(r)[1:9] for r in quality_rules.judge(docs, none).collect()}
    assert {i: g[:6] for i, g in got.items()} == {i: plain_counts(t) for i, t in enumerate(texts)}
    assert all(kept == (not failed) and rule is None for *_, failed, kept, rule in got.values())


def test_list_is_learned_in_order(spark):
    rows = [(i, (i * 37) % 100 / 100, (i * 61) % 100 / 100) for i in range(4000)]
    data = [(x, y, int(x > 0.7 or (y <= 0.2 and x <= 0.3)), i % 3) for i, x, y in rows]
    made = spark.createDataFrame(data, "x double, y double, bad int, fold int")
    rules = quality_rules.learn(made, "bad", "fold", ["x", "y"])
    assert [c.statistic for c in rules[0]] == ["x"] and rules[0][0].above and abs(rules[0][0].threshold - 0.7) < 0.03
    values = {n: F.col(n) for n in "xy"}
    hit = F.lit(False)
    for rule in rules:
        hit = hit | quality_rules._matches(rule, values)
    wrong = made.filter(hit != (F.col("bad") == 1)).count()
    assert wrong < 200
    assert quality_rules.learn(made.filter("bad = 0"), "bad", "fold", ["x", "y"]) == []
    assert quality_rules.learn(made.limit(0), "bad", "fold", ["x", "y"]) == []


def test_learned_rules_reject_bad_and_keep_good(spark):
    labels = table(spark, MEDIUM, "labels")
    got = quality_rules.judge(table(spark, MEDIUM, "documents"), labels).join(labels, "doc_id").filter("NOT base_failed").collect()
    bad, good = [r for r in got if r.quality == 0], [r for r in got if r.quality == 1]
    assert sum(not r.kept for r in bad) / len(bad) > 0.8 and sum(r.kept for r in good) / len(good) > 0.98


def test_odd_labels_and_columns(spark):
    docs = spark.createDataFrame([(1, "w " * 30, "c"), (1, "w " * 30, "c"), (None, " ".join(map(str, range(30))), "c"), (2, None, "c")],
                                 "doc_id long, text string, counts string")
    labels = spark.createDataFrame([(1, 0), (1, None), (1, 1), (None, 1), (8, 0)], "doc_id long, quality int")
    assert sorted((str(r.doc_id), r.kept) for r in quality_rules.judge(docs, labels).collect()) == [
        ("1", False), ("1", False), ("2", False), ("None", True)]
    assert [tuple(r) for r in quality_rules.kept(docs, labels).collect()] == [(None, " ".join(map(str, range(30))), "c")]
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


# Sharding

def test_shards_are_even_and_stable(spark):
    names = [f"n{i}" for i in range(16)]
    old, new = sharding.lookup_table(names), sharding.lookup_table(names + ["n16"])
    sizes = Counter(old)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(old) == sharding.SLOTS
    others = sum(a != b and b != 16 for a, b in zip(old, new)) / len(old)
    assert others < 0.05
    back = sharding.lookup_table(names[::-1])
    assert [names[::-1][i] for i in back] == [names[i] for i in old]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)


def test_place_of_each_row(spark):
    rows = op5_sharding(spark, SMALL).collect()
    names = [f"shard-{i:03d}" for i in range(64)]
    owner = sharding.lookup_table(names)
    for r in rows:
        at = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (at, names[owner[at]])
    assert len(rows) == table(spark, SMALL, "documents").count()


def test_place_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a", 1), (5, None, 2), (5, None, 2)], "doc_id long, shard string, slot long")
    got = sharding.place(docs, ["x", "y"], slots=11)
    assert got.columns == ["doc_id", "shard", "slot", "_slot", "_shard"] and got.count() == 3
    assert len({r._shard for r in got.collect() if r.doc_id == 5}) == 1
    assert sharding.place(docs.limit(0), ["x"], slots=2).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"), ["x", "y"], slots=11)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


# Site quality

def test_sites_shrink_to_their_parents(spark):
    rows = [(i, "big bad" if i < 300 else f"small{i}", int(i >= 300 or i % 10 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, "same text", s) for i, s, _ in rows] + [(900, "same text", "big bad"), (901, None, None)],
                                 "doc_id long, text string, site string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality.classify(docs, labels, ["site"]).collect()}
    assert got[900].prior < 0.15 and not got[900].kept
    share = (sum(q for *_, q in rows) + 1) / (len(rows) + 2)
    assert abs(got[901].prior - share) < 0.01  # no site: the share of all rows
    assert got[350].prior < share + 0.01  # the only labelled row of its site does not judge itself
    assert site_quality.classify(docs.limit(0), labels, ["site"]).count() == 0
    assert {r.prior for r in site_quality.classify(docs, labels.limit(0), ["site"]).collect()} == {0.5}


def plain_priors(rows, levels):
    """The prior of each (id, keys, label) by the formulas, level by level."""
    known = [r for r in rows if r[2] is not None]
    prior = {r[0]: (sum(k[2] for k in known) - (r[2] or 0) + 1) / (len(known) - (r[2] is not None) + 2) for r in rows}
    for n in range(levels):
        groups = defaultdict(list)
        for r in rows:
            if all(k is not None for k in r[1][:n + 1]):
                groups[r[1][:n + 1]].append(r)
        spread = size = count = 0
        for own in groups.values():
            marks = [r[2] for r in own if r[2] is not None]
            if len(marks) > 1:
                m = sum(prior[r[0]] for r in own if r[2] is not None) / len(marks)
                spread += len(marks) * (sum(marks) / len(marks) - m) ** 2 / (m * (1 - m))
                size, count = size + len(marks), count + 1
        weight = 1000.0
        if count and size > count and (beyond := (spread - count) / (size - count)) > 0:
            weight = min(1000.0, max(1.0, 1 / beyond - 1))
        for own in groups.values():
            good, marks = sum(r[2] or 0 for r in own), sum(r[2] is not None for r in own)
            for r in own:
                prior[r[0]] = (good - (r[2] or 0) + weight * prior[r[0]]) / (marks - (r[2] is not None) + weight)
    return prior


def test_priors_against_plain_formulas(spark):
    """Sources differ much, their hosts hardly: hosts are drawn to their source, not to the mean of all."""
    rng, rows = random.Random(6), []
    for i in range(1500):
        source = rng.choice(["good", "bad", "mixed", None])
        host = f"{source}{rng.randrange(25)}" if source and rng.random() < 0.9 else None
        share = {"good": 0.95, "bad": 0.1, "mixed": 0.5, None: 0.5}[source]
        rows.append((i, (source, host), int(rng.random() < share) if rng.random() < 0.6 else None))
    docs = spark.createDataFrame([(i, "same text", *keys) for i, keys, _ in rows], "doc_id long, text string, source string, host string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if q is not None], "doc_id long, quality int")
    got = {r.doc_id: r.prior for r in site_quality.classify(docs, labels, ["source", "host"]).collect()}
    want = plain_priors(rows, 2)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    sparse = [got[i] for i, (source, host), _ in rows if source == "bad" and host]
    assert max(sparse) < 0.35


def test_sites_and_texts_without_labels(spark):
    """Accuracy on rows whose labels were not learned from."""
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    learned = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rows = site_quality.classify(docs, learned, ["source"]).join(labels.join(learned, "doc_id", "left_anti"), "doc_id").collect()
    assert len(rows) > 80 and sum((r.quality == 1) == r.kept for r in rows) / len(rows) > 0.93


def test_evidence_against_plain_formula(spark):
    """Bins at exact ranks, and each labelled row left out of the counts that judge it."""
    rng = random.Random(8)
    rows = [(i, float(rng.randrange(12)), rng.random(), rng.choice([0, 1, 1, None])) for i in range(300)]
    known = [r for r in rows if r[3] is not None]
    want = dict.fromkeys(range(300), 0.0)
    for at in (1, 2):
        ordered = sorted(r[at] for r in known)
        cuts = sorted({ordered[len(ordered) * i // site_quality.BINS] for i in range(1, site_quality.BINS)})
        place = {r[0]: sum(c < r[at] for c in cuts) for r in rows}
        for r in rows:
            others = [k for k in known if k is not r]
            share = [(sum(k[3] == q and place[k[0]] == place[r[0]] for k in others) + 1)
                     / (sum(k[3] == q for k in others) + len(cuts) + 1) for q in (1, 0)]
            want[r[0]] += site_quality.TEMPER * math.log(share[0] / share[1])
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id long, a double, b double, good int").repartition(parts)
        got = {r.id: r.e for r in df.select("id", site_quality._evidence(df, ["a", "b"]).alias("e")).collect()}
        assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_clashing_names(spark):
    """Columns named like those that the classifier makes are no trouble, and the levels may be among them."""
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, "some words", "a", "b", 3), (2, None, None, "b", 4), (3, long, "a", None, None)],
                                 "doc_id long, text string, counts string, level0 string, good int")
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, quality int, evidence string")
    got = site_quality.classify(docs, labels, ["counts", "level0"]).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3] and all(r.kept for r in got)


def test_site_classifier_on_labels(spark):
    labels = table(spark, MEDIUM, "labels")
    got = op10_site_quality(spark, MEDIUM)
    assert got.count() == table(spark, MEDIUM, "documents").count()
    rows = got.join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum((r.quality == 1) == r.kept for r in rows) / len(rows) > 0.95
    assert sum(r.kept for r in good) / len(good) > 0.98
