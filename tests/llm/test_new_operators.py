"""Prefix trie, collocations and line deduplication on odd rows, against plain versions."""

from __future__ import annotations

import gc
import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import pytest

from rainledger.llm import collocations, line_dedup, prefix_trie

SPACES = "[\x20\x09-\x0d]+"
CONV = "conv_id long, turn long, role string, text string, node string"


def plain_trie(rows):
    """The rows of the trie from all prefixes of all conversations."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    members = defaultdict(list)
    for c, turns in own.items():
        path = tuple(t[2:] for t in sorted(turns))
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path)))
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, found in members.items():
        words = len([w for w in re.split(SPACES, p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(found) - 1) * words
    return sorted(((min(found)[0], len(p), min(members[p[:-1]])[0] if p else None, len(found), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c, n in sorted(found) if n == len(p)).encode()).hexdigest())
                   for p, found in members.items()), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_trie_of_odd_rows(spark):
    rows = [(1, 0, "u", "a b"), (1, 1, None, None), (2, None, "u", "first"), (2, 0, "u", "a b"), (3, 0, "u", "a b"), (3, 1, "", ""),
            (3, 2, "u", "long " * 50_000), (4, 0, "u", "a b"), (4, 1, "v", ""), (5, 0, "u", "a b"), (5, 0, "u", "a b"),
            (None, 0, "u", "lost"), (-7, 0, "u", "a b"), (6, 0, "x", "  y"), (7, 0, "u", "a b"), (7, 1, "", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], CONV)
    assert rows_of(prefix_trie.prefix_trie(df)) == plain_trie(rows)
    assert rows_of(prefix_trie.prefix_trie(df.limit(0))) == []


def test_trie_of_paths_and_branches(spark):
    """Conversations that end along one long path, part from it, and copies of them."""
    rng, rows = random.Random(3), []
    for c in range(90):
        path = [f"t{i}" for i in range(rng.randint(1, 70))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(path))
            path[at:] = [f"{w} x{rng.randint(0, 2)}" for w in path[at:at + rng.randint(1, 4)]]
        rows += [(c, i, "u", w) for i, w in enumerate(path)]
    rows += [(c + 200, i, r, w) for c, i, r, w in rows if c % 3 == 0]
    df = spark.createDataFrame([(*r, "") for r in rows], CONV)
    assert rows_of(prefix_trie.prefix_trie(df)) == plain_trie(rows)


def test_rebuilt_conversations_without_turns(spark):
    """With ``most`` = 1 nothing is taken; a short conversation may lose all its turns."""
    rows = [(c, i, "u", f"{c % 5} {i}") for c in range(60) for i in range(1 + c % 3)]
    df = spark.createDataFrame([(*r, "") for r in rows], CONV)
    assert rows_of(prefix_trie.branched_trie(df, most=1)) == plain_trie(rows)
    got = prefix_trie.branched_trie(df.filter("conv_id % 20 <> 0"))
    root = got.filter("depth = 0").first()
    assert root.n_convs == 57 and root.ends_sha256 != hashlib.sha256(b"").hexdigest()


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for a, b, f in df.select("a", "b", prefix_trie.fattest(df.a, df.b)).collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def plain_collocations(rows, longest, least, inside, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        longer = Counter()
        for p, n in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], n)
        scored = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= inside * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits, chunk, top", [(1 << 27, 1 << 22, 2000), (1 << 15, 50, 7)])
def test_collocations_against_brute_force(spark, monkeypatch, bits, chunk, top):
    """Also where pairs share bits, texts fill many chunks and the top is short."""
    monkeypatch.setattr(collocations, "BITS", bits)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rng = random.Random(2)
    words = ["New", "york", "city", "hall", "Été", "of", "the", "a b", "x\x1fy", "\x00"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", " : ", "!?"]
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), "".join(
        rng.choice(["new york city hall", rng.choice(words)]) + rng.choice(ends[:3] * 5 + ends) for _ in range(rng.randint(0, 60))))
        for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, " . , "), ("en", "lonely"), ("fr", "of the " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int")
    got = rows_of(collocations.collocations(df, min_count=8, top=top))
    assert got == sorted(plain_collocations(rows, 5, 8, 100, top), key=str) and len(got) > 10
    assert rows_of(collocations.collocations(df.limit(0))) == []


def test_forgotten_words_are_freed_at_once():
    gc.disable()
    try:
        words = collocations._Words()
        assert words.numbers([b"one two one", b"Two."]).tolist() == [0, 1, 0, -1, 1, -1, -1]
        texts = words.texts
        del words
        assert texts == [b"one", b"two"] and sys.getrefcount(texts) == 2
    finally:
        gc.enable()


def test_scores_beyond_64_bits(spark):
    big = 10 ** 11
    known = spark.createDataFrame([("en", [], 9 * 10 ** 12), ("en", ["a"], 3 * big), ("en", ["b"], 2 * big), ("en", ["a", "b"], big)],
                                  "lang string, words array<string>, f long")
    row = collocations._scored(known, 100).first()
    assert row.score == 1000 * big * 9 * 10 ** 12 // (6 * big * big)


def plain_lines(rows, chars, least):
    """(id, n_lines, n_dropped, text) by the definition; a row is a document unless id and text repeat."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add((i, text))
    low = float("-inf")
    last = {k: max(low if i is None else i for i, _ in h) for k, h in holders.items() if len(h) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x), low if i is None else i) == (low if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"  Line {k} of the pool that is long enough, É {'x' * (k % 7)}" for k in range(12)]
    short = ["short", "", " ", "the edge of forty characters is here 1234"[:39], "the edge of forty characters is here 1234"[:40] + "\t\r"]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool if rng.random() < 0.5 else short) for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.3 else x for x in lines)))
    rows += [(70, None), (71, ""), (72, "\n"), (73, pool[0] + "\n" + pool[0]), (73, pool[0] + "\nother"), (73, pool[0] + "\nother"),
             (None, pool[1] + "\nand more"), (None, None), (80, ("word " * 20 + "\n") * 20_000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, text_hash string, n_lines int")
    got = line_dedup.without_repeated_lines(df)
    assert got.columns == [*df.columns, "_n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r._n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == plain_lines(rows, 40, 5)
    digests = {(r.doc_id, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(df).collect()}
    assert digests == {(i, d, hashlib.sha256(t.encode()).hexdigest()) for i, _, d, t in plain_lines(rows, 40, 5)}
    assert line_dedup.line_digests(df.limit(0)).count() == 0


def test_lines_of_documents_without_ids(spark):
    line = "a line that is certainly long enough to be looked at"
    df = spark.createDataFrame([(None, f"{line}\n{k}") for k in range(6)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.line_digests(df).collect()} == {0}
