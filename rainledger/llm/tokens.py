"""Token ids of whole texts by the tokenizers library, with a memory of frequent words.

A text is cut at blanks and line ends into units that the tokenizer never joins; each distinct unit is
encoded by the library once and remembered by the worker process. Texts for which such cuts could
change the ids, those with rarer white space or with the string of a special token, are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .units import Memory

#: White space other than blank, line feed, carriage return and tab, by any definition of it.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Units that are encoded in one call, apart from each other by a special token.
TOGETHER = 200

_encoders: dict[tuple[str, bool], Callable[[list[str]], list[bytes]]] = {}


def encoder(path: str, blank_with_word: bool) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, each as little-endian unsigned 32-bit integers.

    ``blank_with_word``: a blank before a word belongs to its unit (byte-level vocabularies); else
    white space is no part of any unit (vocabularies that drop it).
    """
    key = (path, blank_with_word)
    if key not in _encoders:
        _encoders[key] = _encoder(path, blank_with_word)
    return _encoders[key]


def _encoder(path: str, blank_with_word: bool) -> Callable[[list[str]], list[bytes]]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import numpy as np
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    specials = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
    special = re.compile("|".join(map(re.escape, specials))) if specials else None
    between, mark = next(iter(specials.items()), (None, -1))
    # The alternatives for white space give a run's last blank to the word after it, as the library does.
    units = re.compile(r" ?[^ \n\r\t]+|[ \n\r\t]+(?![^ \n\r\t])|[ \n\r\t]+" if blank_with_word else r"[^ \n\r\t]+").findall

    def ids(texts: list[str]) -> list:
        return [np.asarray(e.ids, np.uint32) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_units(new: list[str]) -> tuple:
        if between is None:
            found = ids(new)
            return np.array([len(x) for x in found], np.int64), np.concatenate(found)
        # A special token ends what is before it, and no unit holds one.
        joined = [between.join([*new[i:i + TOGETHER], ""]) for i in range(0, len(new), TOGETHER)]
        flat = np.concatenate(ids(joined))
        marks = np.flatnonzero(flat == mark)
        return np.diff(np.r_[-1, marks]) - 1, flat[flat != mark]

    memory = Memory(encode_units)

    def encode(texts: list[str]) -> list[bytes]:
        odd = [bool(RARE_SPACE.search(t) or special and special.search(t)) for t in texts]
        whole = iter(ids([t for t, o in zip(texts, odd) if o]))
        cut = iter(memory.texts(units(t) for t, o in zip(texts, odd) if not o))
        return [next(whole if o else cut).astype("<u4").tobytes() for o in odd]

    return encode
