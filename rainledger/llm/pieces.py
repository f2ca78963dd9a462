"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file gives the pieces and their scores. A pair of adjacent symbols can be merged if the
joined text is a piece; its rank is the piece's place in descending order of scores. The words of a
batch lie in flat numpy arrays: a symbol and the rank of its pair with the next one per position. In
each round every word merges at its lowest rank, all words at once; the arrays are then compacted, and
only the pairs beside a merge are ranked anew. Words without a pair leave the arrays.

A round merges the leftmost of the lowest pairs of each word. In a word of more than ``LONG``
characters it merges every pair that is the lowest within twice the length of the longest piece on both
sides. Merges of lower rank elsewhere cannot come nearer than one piece reaches, so the result is still
that of merging one pair at a time, and the number of rounds does not grow with the word.

Words end where a blank follows another character; the model is checked to have no piece across such a
place. Each distinct word of a batch is merged once, and frequent ones are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import col
from .units import Memory, slices

#: The character that stands for a blank in pieces.
BLANK = "▁"
#: Rank of a pair that cannot be merged.
NEVER = (1 << 31) - 1

#: Words with more characters merge at many places in a round.
LONG = 64

WORD = re.compile(r" *[^ ]+| +").findall


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at:at + size]
            at += size


class PieceModel:
    """A BPE model file of the sentencepiece library."""

    def __init__(self, path: str) -> None:
        import numpy as np
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        parts = dict(_fields(model.serialized_model_proto()))
        trainer, normalizer = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only BPE models with white space as a prefix are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that keep texts as they are and add a leading blank are supported")
        if any(dict(_fields(v)).get(3, 1) in (4, 5) for n, v in _fields(model.serialized_model_proto()) if n == 1):
            raise ValueError("user-defined and unused pieces are not supported")
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(BLANK in names[i].lstrip(BLANK) for i in normal):
            raise ValueError("a piece goes across the beginning of a word")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(model.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte pieces")
        # Symbols: pieces keep their ids; other characters of pieces get numbers above.
        self.symbols = {names[i]: i for i in normal}
        self.n_ids = n
        for c in sorted({c for i in normal for c in names[i]} - self.symbols.keys()):
            self.symbols[c] = len(self.symbols) + n
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        rank = {i: place[model.get_score(i)] for i in normal}
        pairs = {}
        for i in normal:
            text = names[i]
            for k in range(1, len(text)):
                a, b = self.symbols.get(text[:k]), self.symbols.get(text[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.ranks = np.array([rank[i] for i in self.merged.tolist()], np.int32)
        self.contents = [
            b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i)
            else bytes([int(names[i][1:-1], 16)]) if model.is_byte(i) else names[i].replace(BLANK, " ").encode()
            for i in range(n)]
        self.is_blank_first = [c.startswith(b" ") and not model.is_byte(i) and not model.is_unknown(i)
                               for i, c in enumerate(self.contents)]
        self.skipped = {i for i in range(n) if model.is_control(i)}
        self.decimals = [b"%d" % i for i in range(n)]
        self.longest = max(len(names[i]) for i in normal)
        self.longest_run = self._longest_run(rank, names)
        self.memory = Memory(self._encode_new)

    def _longest_run(self, rank: dict[int, int], names: list[str]) -> int:
        """L if blanks merge after all else and every L blanks end as one piece while more follow; else 0.

        If all pieces of blanks have one rank, below that of any other pair, blanks are merged from the
        left, until the first piece has the largest length and can grow no more. This does not depend on
        how many follow, so it is enough to see it on some lengths.
        """
        runs = {len(names[i]): r for i, r in rank.items() if len(names[i]) > 1 and not names[i].strip(BLANK)}
        others = max((r for i, r in rank.items() if len(names[i]) > 1 and names[i].strip(BLANK)), default=-1)
        if not runs or len(set(runs.values())) > 1 or min(runs.values()) <= others:
            return 0
        longest = max(runs)
        lengths, ids = self.encode_words([BLANK * n for n in range(longest, 4 * longest)])
        found, at = [], 0
        for n in lengths.tolist():
            found.append(ids[at:at + n].tolist())
            at += n
        first = self.symbols[BLANK * longest]
        regular = all(found[n + longest] == [first, *found[n]] for n in range(1, 2 * longest))
        return longest if regular else 0

    def _encode_new(self, words: list[str]):
        """(number of ids per word, all ids); long runs of blanks are taken off before the merge rounds."""
        import numpy as np

        run, cut, off = self.longest_run, [], []
        for w in words:
            blanks = len(w) - len(w.lstrip(" "))
            k = (blanks - run) // run if run and blanks > 2 * run else 0
            off.append(k)
            cut.append(w[k * run:].replace(" ", BLANK))
        lengths, ids = self.encode_words(cut)
        if any(off):
            front = np.array(off)
            ids = np.insert(ids, np.repeat(np.cumsum(lengths) - lengths, front), self.symbols[BLANK * run])
            lengths = lengths + front
        return lengths, ids

    def _pair(self, a, b):
        """(rank, merged symbol) of pairs of symbols."""
        import numpy as np

        wanted = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[at] == wanted
        return np.where(found, self.ranks[at], NEVER).astype(np.int32), np.where(found, self.merged[at], -1).astype(np.int32)

    def encode_words(self, words: list[str]):
        """(number of ids per word, all ids) of words whose blanks are BLANK already."""
        import numpy as np

        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        distinct, place = np.unique(codes, return_inverse=True)
        # Characters that are in no piece become bytes at the end; negative until then.
        numbers = np.array([self.symbols.get(chr(c), -1 - int(c)) for c in distinct.tolist()], np.int64)
        symbol = numbers[place]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        is_long = np.repeat(lengths > LONG, lengths)
        short, long = self._merge(symbol[~is_long], word[~is_long], False), self._merge(symbol[is_long], word[is_long], True)
        symbol, word = np.r_[short[0], long[0]], np.r_[short[1], long[1]]
        order = np.argsort(word, kind="stable")
        return self._ids(symbol[order], word[order], len(words))

    def _merge(self, symbol, word, is_long: bool):
        """Merge rounds over flat symbols until no pair is left; the final (symbol, word)."""
        import numpy as np

        done_symbols, done_words = [], []
        rank, merged = self._ranked(symbol, word)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(word)])
            stay = lowest != NEVER
            if not stay.all():
                kept = np.repeat(stay, sizes)
                done_symbols.append(symbol[~kept])
                done_words.append(word[~kept])
                symbol, word, rank, merged = symbol[kept], word[kept], rank[kept], merged[kept]
                lowest, sizes = lowest[stay], sizes[stay]
                if not len(symbol):
                    break
            if is_long:
                at = self._local_minima(symbol, word, rank, merged)
            else:
                at = np.flatnonzero(rank == np.repeat(lowest, sizes))
                at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            symbol[at] = merged[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            symbol, word, rank, merged = symbol[keep], word[keep], rank[keep], merged[keep]
            redo = np.unique(np.r_[new, new[new > 0] - 1])
            last = redo + 1 >= len(symbol)
            after = np.where(last, redo, redo + 1)
            ranks, pieces = self._pair(symbol[redo], symbol[after])
            apart = last | (word[redo] != word[after]) | (symbol[redo] < 0) | (symbol[after] < 0)
            rank[redo], merged[redo] = np.where(apart, NEVER, ranks), np.where(apart, -1, pieces)
        if not done_symbols:
            return symbol, word
        return np.concatenate(done_symbols), np.concatenate(done_words)

    def _local_minima(self, symbol, word, rank, merged):
        """Places to merge: none near them has a lower rank, nor an equal one on the left that goes first."""
        import numpy as np

        reach = 1 << (2 * self.longest).bit_length()
        n = len(rank)

        def lowest_near(values):
            """Minima over the ``reach`` values before and after each place."""
            window = np.concatenate([np.full(reach, NEVER, values.dtype), values, np.full(2 * reach, NEVER, values.dtype)])
            step = 1
            while step < reach:
                window = np.minimum(window[:-step], window[step:])
                step *= 2
            return window[:n], window[reach + 1:reach + 1 + n]

        left, right = lowest_near(rank)
        lowest = (rank <= left) & (rank <= right) & (rank != NEVER)
        at = np.flatnonzero(lowest)
        late, _ = lowest_near(np.where(lowest, NEVER, rank))
        # Of overlapping places (aaa) the first, third and so on merge.
        row_start = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        odd = (np.arange(len(at)) - np.repeat(row_start, np.diff(np.r_[row_start, len(at)]))) % 2
        at = at[odd == 0]
        # Equal ranks go from left to right. One waits if one near it on the left cannot merge yet, or is
        # hot: its piece could merge on at once, at a rank as low. So do those near a waiting one.
        here, piece = at, merged[at]
        before, after = np.maximum(here - 1, 0), np.minimum(here + 2, n - 1)
        left = np.where((here > 0) & (word[before] == word[here]), symbol[before], -1)
        beside = np.r_[False, np.diff(at) == 2]
        left = np.where(beside, np.r_[0, piece[:-1]], left)
        right = np.where((here + 2 < n) & (word[after] == word[here]), symbol[after], -1)
        hot = np.zeros(len(at), bool)
        for a, b, other in ((left, piece, left), (piece, right, right)):
            found, _ = self._pair(np.maximum(a, 0), np.maximum(b, 0))
            hot |= (other >= 0) & (found <= rank[here])
        waits = late[at] <= rank[at]
        before_it = np.cumsum(waits | hot) - (waits | hot)
        starts = np.flatnonzero(np.r_[True, np.diff(at) > reach])
        return at[(before_it == np.repeat(before_it[starts], np.diff(np.r_[starts, len(at)]))) & ~waits]

    def _ranked(self, symbol, word):
        import numpy as np

        rank, merged = np.full(len(symbol), NEVER, np.int32), np.full(len(symbol), -1, np.int32)
        near = np.flatnonzero((word[1:] == word[:-1]) & (symbol[1:] >= 0) & (symbol[:-1] >= 0))
        rank[near], merged[near] = self._pair(symbol[near], symbol[near + 1])
        return rank, merged

    def _ids(self, symbol, word, n: int):
        """Symbols that are no piece become the byte pieces of their character."""
        import numpy as np

        odd = np.flatnonzero((symbol < 0) | (symbol >= self.n_ids))
        if len(odd):
            single = {v: ord(c) for c, v in self.symbols.items() if v >= self.n_ids}
            raw = [chr(single[s] if s >= 0 else -1 - s).encode() for s in symbol[odd].tolist()]
            repeat = np.ones(len(symbol), np.int64)
            repeat[odd] = [len(r) for r in raw]
            starts = np.repeat((np.cumsum(repeat) - repeat)[odd], repeat[odd])
            inside = np.arange(len(starts)) - np.repeat(np.cumsum(repeat[odd]) - repeat[odd], repeat[odd])
            symbol, word = np.repeat(symbol, repeat), np.repeat(word, repeat)
            symbol[starts + inside] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return np.bincount(word, minlength=n), symbol.astype(np.uint32)

    def encode(self, texts: list[str]) -> list:
        """Ids of each text as an array, as the library gives them without begin, end or sampling."""
        return self.memory.texts(WORD(f" {t.replace(BLANK, ' ')}") if t else () for t in texts)

    def decode(self, ids) -> str:
        """The text of an array of ids: bytes become characters, bytes that are none a replacement each."""
        import numpy as np

        ids = np.asarray(ids).tolist()
        first = next((i for i in ids if i not in self.skipped), None)
        parts: list[list[int]] = [[]]
        for i in ids if self.skipped.intersection(ids) else ():
            if i in self.skipped:  # ends a run of bytes
                parts.append([])
            else:
                parts[-1].append(i)
        whole = parts if len(parts) > 1 else [ids]
        text = "".join(b"".join(map(self.contents.__getitem__, p)).decode("utf-8", "one_each") for p in whole)
        return text[1:] if first is not None and self.is_blank_first[first] else text


def _register() -> None:
    import codecs

    codecs.register_error("one_each", lambda e: ("�" * (e.end - e.start), e.end))


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    _register()
    return PieceModel(path)


def _coded(path: str):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        model = piece_model(path)
        decimal = model.decimals.__getitem__
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for a, b in slices(texts):
                for ids in model.encode(texts[a:b]):
                    listed = b",".join(map(decimal, ids.tolist()))
                    rows.append((len(ids), hashlib.sha256(listed).hexdigest(),
                                 hashlib.sha256(model.decode(ids).encode()).hexdigest()))
            n, ids_sha, text_sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def piece_digests(df: DataFrame, model: str, *, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: each text encoded, and decoded from its ids.

    A NULL text counts as empty; an empty text has no ids. NULL and repeated ids are kept. An empty
    table gives an empty result.
    """
    rows = df.select(col(id_column).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_coded(model), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string") \
        .withColumnRenamed("id", id_column)


def _encoded(path: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = piece_model(path)
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in slices(texts):
                out += [x.astype(np.int32) for x in model.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def encode_pieces(df: DataFrame, model: str, *, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, ids) per row, ids as an array; NULL and empty texts have an empty one."""
    rows = df.select(col(id_column).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(model), f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode_pieces(df: DataFrame, model: str, *, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """(id, text) per row of (id, ids); NULL ids have a NULL text."""
    rows = df.select(col(id_column).alias("id"), col(ids).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decode = piece_model(model).decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
