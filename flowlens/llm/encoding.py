"""Token ids of whole texts through the tokenizers library, each distinct stretch between spaces encoded once.

Both public vocabularies used here cut every text before a space or line feed that follows another character that is
no white space, and after a run of letters that an ASCII character other than a letter follows, whatever stands
further off. So a text's ids are those of its stretches one after the other, and a
worker keeps the ids of the stretches it has met lately. New stretches are encoded many at a time as one text, with a
digit that none of them holds between two. Texts that hold a special token of the vocabulary are encoded whole, as the
library does.
"""

from __future__ import annotations

import gc
import re
from array import array

import numpy as np

#: Stretches in either of a worker's two generations, the longest that is kept, in characters, and those encoded at a time.
KEPT, LONGEST, AT_ONCE = 600_000, 40, 4096
#: Digits that stand between stretches, tokens of their own; stretches that hold one are joined by the next.
MARKS = "0123"

_LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7f])"
_SOLID = re.compile(rf"{_LETTERS}|[^ \n]+")
_STRETCH = re.compile(rf"[ \n]*{_LETTERS}|[ \n]*[^ \n]+|[ \n]+")
#: Other white space before a space or line feed joins it in one token, so that such texts are encoded whole.
_ODD = re.compile(r"[^\S \n][ \n]")
_workers: dict[str, Encoder] = {}


class _Kept(dict):
    """Ids by stretch; asked for one that it lacks, it notes it and gives None, until update()."""

    __slots__ = ("new",)

    def __missing__(self, stretch: str) -> None:
        self.new.append(stretch)
        self[stretch] = None


class Encoder:
    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.most = kept
        self.tok = Tokenizer.from_file(path)
        self.young, self.old = _Kept(), _Kept()
        #: Texts with a special token, or one in other case, are left to the library.
        special = "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        self.special = re.compile(special or r"(?!)", re.I)
        #: Some vocabularies drop white space, and fold the case of ASCII letters; then stretches can do without both.
        self.drops = self._ids("x \n y") == self._ids("x") + self._ids("y")
        self.folds = self._ids("AZ") == self._ids("az")
        found = [(m, self._ids(f"a {m} a")[1:-1]) for m in MARKS]
        self.marks = [(m, ids[0]) for m, ids in found if len(ids) == 1]

    @staticmethod
    def of(path: str, kept: int = KEPT) -> Encoder:
        """The worker's own encoder for a vocabulary file; a generation of its cache holds `kept` stretches, some 170 bytes each."""
        if path not in _workers:
            gc.set_threshold(50_000, 20, 20)  # many short lists of strings, no cycles
            _workers[path] = Encoder(path, kept)
        return _workers[path]

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _together(self, stretches: list[str], mark: str, of: int) -> list[bytes]:
        """Ids of stretches that begin with white space, or may, and end with none, from one text of them all."""
        ids = np.array(self._ids((f" {mark} " if self.drops else f" {mark}").join(["", *stretches, ""])), dtype=np.uint32)
        at = np.flatnonzero(ids == of)
        if len(at) != len(stretches) + 1:
            return [array("I", self._ids(s)).tobytes() for s in stretches]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * (at[:-1] + 1)).tolist(), (4 * at[1:]).tolist(), strict=True)]

    def _new(self, stretches: set[str]):
        """(stretch, ids) of each."""
        left = [s for s in stretches if (self.drops or s[0] in " \n") and not s[-1].isspace()]
        alone = stretches.difference(left)
        for mark, of in self.marks:
            joint, left = [s for s in left if mark not in s], [s for s in left if mark in s]
            for i in range(0, len(joint), AT_ONCE):
                part = joint[i : i + AT_ONCE]
                yield from zip(part, self._together(part, mark, of), strict=True)
        for s in (*left, *alone):
            yield s, array("I", self._ids(s)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.young) > self.most:
            self.young, self.old = _Kept(), self.young
        find = (_SOLID if self.drops else _STRETCH).findall
        young, get = self.young, self.young.__getitem__
        young.new = new = []
        cut, values, open_ = [], [], []
        for i, t in enumerate(texts):
            if self.special.search(t):
                cut.append(None)
                values.append([array("I", self._ids(t)).tobytes()])
                continue
            if self.folds:
                t = t.encode().lower().decode()
            parts, before = [t] if _ODD.search(t) else find(t), len(new)
            cut.append(parts)
            values.append(list(map(get, parts)))
            if new and (len(new) > before or None in values[-1]):
                open_.append(i)
        if new:
            old = {s: self.old[s] for s in self.old.keys() & new}
            young.update(old)
            young.update(self._new(set(new).difference(old)))
            for i in open_:
                row, parts, at = values[i], cut[i], -1
                for _ in range(row.count(None)):
                    at = row.index(None, at + 1)
                    row[at] = young[parts[at]]
        out = [b"".join(v) for v in values]
        for s in new:
            if len(s) > LONGEST:
                del young[s]
        return out


def portions(texts, most: int = 1_000_000):
    """Index ranges over `texts` of at most `most` characters, or of one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
