"""A worker's memory of encoded units of text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

#: Units that a worker process remembers before it starts anew.
REMEMBERED = 600_000


class Memory:
    """Ids of texts that are cut into units; each distinct unit is encoded once.

    ``encode`` gets new units and returns (number of ids per unit, all ids). What is remembered changes
    the time only. When there are more than ``limit`` units, all are forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], tuple], limit: int = REMEMBERED) -> None:
        self.encode, self.limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.number = _Numbers()
        self.known = 0
        self.lengths, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def texts(self, cut: Iterable[Iterable[str]]) -> list:
        """The ids of each text as an array of unsigned 32-bit integers."""
        import numpy as np

        if self.known > self.limit:
            self._forget()
        get = self.number.__getitem__
        # Units of one text are looked up before the next text is cut: they are still in the cache.
        places = [np.fromiter(map(get, units), np.int32) for units in cut]
        if len(self.number) > self.known:
            lengths, ids = self.encode(self.number.new)
            self.number.new = []
            self.known = len(self.number)
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(lengths) - lengths]
            self.lengths, self.ids = np.r_[self.lengths, lengths], np.r_[self.ids, ids]
        flat = np.concatenate(places) if places else np.zeros(0, np.int32)
        sizes = self.lengths[flat]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[flat] - ends + sizes, sizes)
        at += np.arange(len(at))
        bounds = np.r_[0, ends][np.cumsum([len(p) for p in places])] if places else []
        return np.split(self.ids[at], bounds[:-1])


class _Numbers(dict):
    """Numbers unknown units in the order in which they come."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = n = len(self)
        return n


def slices(texts: list[str], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(first, last) positions of runs of texts with about so many characters: bounds what is held at once."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
