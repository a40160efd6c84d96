"""Token ids of whole texts by the tokenizers library, with a bounded cache of word encodings.

A pre-token of either vocabulary never spans a step from a non-space to a white
space character, so a text may be cut there and its chunks be encoded one by
one: the ids are those of the whole text. Most chunks of a corpus are frequent
words, so that the library sees only the rest, many in one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

#: Entries that a worker's cache holds at most, besides those of one batch (about 200 bytes each).
#: The older half goes first, unless it was used again.
CACHE_ENTRIES = 2_000_000
#: Characters of text that are cut at a time.
TEXT_CHARS = 1 << 20

_SPACE = (" ", "\t", "\n", "\r")
_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
_FIRST = "\x00"
_MARKED = (_FIRST, "\n")
_loaded: dict[tuple[str, bool, int], "ChunkEncoder"] = {}


def encoder(path: str, keep_space: bool, entries: int = CACHE_ENTRIES) -> "ChunkEncoder":
    """The worker's encoder for the tokenizer file at ``path``, with a cache of so many encodings."""
    key = (path, keep_space, entries)
    if key not in _loaded:
        _loaded.clear()  # a worker has one at a time
        _loaded[key] = ChunkEncoder(path, keep_space, entries)
    return _loaded[key]


class ChunkEncoder:
    def __init__(self, path: str, keep_space: bool, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep_space = keep_space
        self.entries = entries
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode("\n" if keep_space else "|", add_special_tokens=False).ids[0]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _cut(self, text: str) -> list[str]:
        """Chunks of a text, each with the white space before it (or without, if the vocabulary drops it)."""
        if not self.keep_space:
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if any(r in text for r in _RUNS) or text[0] in _SPACE or text[-1] in _SPACE:
            return [c[1:] if c[0] == " " and c[1:2] not in ("", *_SPACE) else c if c[0] == "\n" else _FIRST + c for c in _CHUNK.findall(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        # a chunk's space is left out of its key: "\n" marks those without one, the first is marked as such
        return [_FIRST + first, *rest]

    def _odd(self, text: str) -> bool:
        """Whether a text may hold a special token's string, or a mark: it goes to the library as it is."""
        return "<|" in text or _FIRST in text

    def _whole(self, text: str) -> str:
        """What is encoded of a text."""
        return text

    def _text(self, key: str) -> str:
        if not self.keep_space or key[0] in _MARKED:
            return key.removeprefix(_FIRST)
        return " " + key

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids (unsigned 32 bit) of each text; a null text has none."""
        return [np.frombuffer(x, dtype="<u4") for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: Iterable[str | None]) -> list[bytes]:
        some, size, out = [], 0, []
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size >= TEXT_CHARS:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [[] if not t else None if self._odd(t) else self._cut(t) for t in texts]
        if len(self.chunks) > self.entries // 2:
            self.old, self.chunks = self.chunks, {}
        # one look at each chunk; those not known are learned together and filled in
        found, gaps, new = [], [], set()
        get = self.chunks.get
        for i, keys in enumerate(cut):
            values = list(map(get, keys or ()))
            found.append(values)
            if None in values:
                at = [j for j, v in enumerate(values) if v is None]
                gaps.append((i, at))
                new.update([keys[j] for j in at])
        if new:
            known = new & self.old.keys()
            self.chunks.update((x, self.old[x]) for x in known)
            self._learn(new - known)
            for i, at in gaps:
                keys, values = cut[i], found[i]
                for j in at:
                    values[j] = self.chunks[keys[j]]
        return [self._ids(self._whole(t)) if keys is None else b"".join(values) for t, keys, values in zip(texts, cut, found, strict=True)]

    def _learn(self, keys: set[str]) -> None:
        """Encode chunks, many in one text, told apart by a token that stands between any two.

        What goes so begins and ends with other than white space and does not hold the mark
        between; its pre-tokens are then those that it has alone."""
        spaced, plain, rest = [], [], []
        mark = "\n" if self.keep_space else "|"
        for key in keys:
            if key.isalpha():
                spaced.append(key)
                continue
            bare = key[1:] if self.keep_space and key[:1] in _MARKED else key
            if not bare or mark in bare or bare[0].isspace() or bare[-1].isspace():
                rest.append(key)
            elif bare is key:
                spaced.append(key)
            else:
                plain.append(key)
        between = f"{mark} " if self.keep_space else f" {mark} "
        self._together(spaced, [*spaced], " " * self.keep_space, between)
        self._together(plain, [k[1:] for k in plain], "", mark)
        texts = [self._text(k) if k else "" for k in rest]
        for key, got in zip(rest, self._batch(texts), strict=True):
            self.chunks[key] = np.array(got.ids, dtype="<u4").tobytes()

    def _batch(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _together(self, keys: list[str], texts: list[str], before: str, between: str) -> None:
        feed = self._ids("\n") if self.keep_space else b""
        for at in range(0, len(keys), 20_000):
            some = keys[at : at + 20_000]
            ids = np.array(self._batch([before + between.join(texts[at : at + 20_000])])[0].ids, dtype="<u4")
            marks = np.flatnonzero(ids == self.mark)
            data = ids.tobytes()
            if len(marks) != len(some) - 1:  # not as foreseen: one by one
                got = [self._ids(self._text(k)) for k in some]
            else:
                starts, ends = [0, *(4 * marks + 4).tolist()], [*(4 * marks).tolist(), len(data)]
                got = [data[a:b] for a, b in zip(starts, ends, strict=True)]
                if not before and self.keep_space:
                    got = [feed + x if k[0] == "\n" else x for k, x in zip(some, got, strict=True)]
            self.chunks.update(zip(some, got, strict=True))
