from __future__ import annotations

import hashlib
import io
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rainledger.llm import packing, pieces, token_files, tokens
from rainledger.llm.columns import table
from rainledger.llm.queries import op3_packing, op8_token_files, op9_pieces, vocabulary
from rainledger.llm.units import Memory

SMALL = "/root/testdata/sf0.001"
PARTS = ["a", "The", " ", "  ", "\n", "\t", "'s", "é", "é", "Σ", "12", "...", " ", " ", "\x1c", "<|endoftext|>",
         "日本", "😀", "‍", "İ", "_", "▁", "<s>", "<0x41>", "\x00", "aaaa", "====", "        "]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize(("name", "blank_with_word"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_ids_of_the_library(name, blank_with_word):
    texts = odd_texts(4000)
    model = Tokenizer.from_file(vocabulary(name))
    want = [np.asarray(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    encode = tokens.encoder(vocabulary(name), blank_with_word)
    assert encode(texts) == want
    assert encode(texts) == want and encode([]) == [] and encode([""]) == [b""]


def test_memory_forgets_without_changing_results():
    calls = []

    def encode(new):
        calls.append(len(new))
        return np.array([len(u) for u in new]), np.array([ord(c) for u in new for c in u], np.uint32)

    memory = Memory(encode, limit=2)
    for _ in range(3):
        assert [a.tolist() for a in memory.texts([["ab", "c"], [], ["ab", "ab", "d"]])] == [
            [97, 98, 99], [], [97, 98, 97, 98, 100]]
    assert calls == [3, 3, 3]


def test_packing_of_a_whole_table(spark):
    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {i: model.encode(t, add_special_tokens=False).ids + [2] for i, t in texts_of(spark).items()}
    check_packed(op3_packing(spark, SMALL).collect(), ids, 4096)


def check_packed(rows, ids, length):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    assert docs.keys() == ids.keys()
    for i, found in docs.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and at & (at - 1) == 0  # 4096 is a power of two as well


def test_packing_merges_over_rounds(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 37)) for i in range(300)], "doc_id long, text string").repartition(23)
    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {i: model.encode("word " * (i % 37), add_special_tokens=False).ids + [2] for i in range(300)}
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json"), length=64, windows=3, fan_in=3).collect()
    check_packed(rows, ids, 64)
    assert len({r.sequence_id for r in rows}) <= sum(map(len, ids.values())) // 64 + 7


def test_best_fit_keeps_a_bounded_number_of_windows():
    done = []
    space = packing.OpenWindows(done.append, length=10, limit=2)
    for name, n in (("a", 7), ("b", 4), ("c", 3), ("d", 6), ("e", 9)):
        space.add(name, b"\0" * 4 * n)
        assert len(space.free) <= 2
    assert [[(p[0], len(p[3]) // 4) for p in w] for w in done][:2] == [[("a", 7), ("c", 3)], [("b", 4), ("d", 6)]]
    with pytest.raises(ValueError):
        packing.pack(None, "", length=100)


def odd_rows(spark):
    return spark.createDataFrame([(5, None, 1), (2, "", 1), (None, "x y", 2), (2, "again", 3), (2, "again", 3),
                                  (9, "long " * 60_000 + "x" * 50_000, 4)], "doc_id long, text string, start long")


def test_odd_rows_of_packing_and_files(spark):
    docs = odd_rows(spark)
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.length) for r in rows if r.doc_id == 5 or r.doc_tokens == 1) == [(2, 1), (5, 1)]
    assert sum(r.length for r in rows if r.doc_id is None) == 3
    got = token_files.token_round_trip(docs, vocabulary("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 2, 5, 9] and len(got) == 6
    assert packing.pack(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0
    assert token_files.token_round_trip(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_token_files_of_a_whole_table(spark):
    model, start, want = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), 0, []
    for i, t in sorted(texts_of(spark).items()):
        ids = model.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op8_token_files(spark, SMALL).collect())) == want


def test_file_format_reads_only_wanted_frames():
    import pyarrow as pa
    import zstandard

    sink, docs = io.BytesIO(), {i: np.arange(i, i + 40_000, dtype="<u4") for i in (3, 4, 8, 9)}
    writer = token_files.TokenFileWriter(sink)
    for i, ids in docs.items():
        writer.add(i, ids.tobytes())
    assert writer.close(pa.int64()) == 160_000
    data = sink.getvalue()
    # Plain decoders read the frames in a row and pass over the seek table.
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.startswith(b"".join(x.tobytes() for x in docs.values()))
    reader, opened = token_files.TokenFileReader(io.BytesIO(data), len(data)), []
    frame = reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    (found,) = [(i, s, n, b"".join(p)) for i, s, n, p in reader.documents({8})]
    assert found == (8, 80_000, 40_000, docs[8].tobytes()) and opened == [1]
    assert {i: b"".join(p) for i, _, _, p in reader.documents()} == {i: x.tobytes() for i, x in docs.items()}
    damaged = bytearray(data)
    damaged[reader.starts[1] + 20] ^= 1
    broken = token_files.TokenFileReader(io.BytesIO(bytes(damaged)), len(data))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.frame(1)
    with pytest.raises((ValueError, struct.error)):
        token_files.TokenFileReader(io.BytesIO(data[:-1]), len(data) - 1)


def test_pieces_equal_the_library():
    path = vocabulary("piece_bpe_32k.model")
    model, library = pieces.piece_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    texts = odd_texts(3000) + ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (65, 700, 9000)] + [
        "a" * 777, "ab" * 999, " " * 5000, "x" + " " * 333 + "▁" * 40 + "the", "the" * 500, "=" * 300]
    want = library.encode(texts)
    assert [x.tolist() for x in model.encode(texts)] == want
    assert [model.decode(x) for x in want] == [library.decode(x) for x in want]
    ids = [[rng.randrange(260) if rng.random() < .5 else rng.randrange(32000) for _ in range(9)] for _ in range(3000)]
    assert [model.decode(x) for x in ids] == [library.decode(x) for x in ids]


def test_piece_digests_of_a_whole_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = set()
    for i, t in texts_of(spark).items():
        ids = library.encode(t)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert set(map(tuple, op9_pieces(spark, SMALL).collect())) == want


def test_odd_rows_of_pieces(spark):
    path, docs = vocabulary("piece_bpe_32k.model"), odd_rows(spark)
    rows = pieces.piece_digests(docs, path).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id, r.n_tokens) for r in rows if r.ids_sha256 == empty) == [(2, 0), (5, 0)] and len(rows) == 6
    back = pieces.decode_pieces(pieces.encode_pieces(docs, path), path).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in back))) == sorted(
        map(str, ((r.doc_id, r.text or "") for r in docs.collect())))
    assert pieces.piece_digests(docs.limit(0), path).count() == 0
