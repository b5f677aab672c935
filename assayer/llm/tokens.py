"""Whole texts to token ids with the tokenizers library.

A tokenizer file cuts a text into pieces by a published pattern and maps each piece to the same ids wherever it stands. A
worker cuts texts by that pattern, keeps the ids of pieces it has met (up to a bound) and gives only new pieces to the
library, many in one call and already cut, so that the library's model does nothing but merge. A text is encoded whole
by the library's plain call if it holds a character for which the two patterns are not known to agree, or the content of
an added token ('<|endoftext|>', say), or if its tokenizer file has other steps than the two known kinds.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np

#: Pieces whose ids a worker keeps.
KEPT = 400_000
#: The pre-tokenizers' published pattern, and how it reads over the characters below.
_PUBLISHED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES, _NUMBERS = r"\t\n\x0b\x0c\r ", "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xffŒœ"
_SHORT = "'(?:[stmd]|re|ve|ll)"
#: Letters and numbers are tried first, which a short form, beginning with its mark, can't be taken for.
_PIECES = {
    "words": rf"[{_LETTERS}]+|[{_NUMBERS}]|{_SHORT}|[^{_SPACES}{_LETTERS}{_NUMBERS}]+",
    "bytes": rf" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|{_SHORT}| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+",
}
#: White space, printable characters up to U+00FF, the two ligatures, and general punctuation.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-\xffŒœ‐-‧‰-›€]*")
_BETWEEN = "\0"


def _byte_table() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself where it is printable, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    table[0] = _BETWEEN  # no piece holds it
    return table


def _kind(steps: dict) -> str | None:
    """Which of the known pre-tokenizers a tokenizer file names; None for any other."""
    pre, normal = steps.get("pre_tokenizer") or {}, steps.get("normalizer")
    if any(t["normalized"] for t in steps.get("added_tokens", ())) or steps.get("post_processor") or steps.get("truncation") or steps.get("padding"):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
        return "bytes"
    inner = pre.get("pretokenizers", [])
    if [p.get("type") for p in inner] != ["Split", "ByteLevel"] or inner[1].get("use_regex") or inner[1].get("add_prefix_space"):
        return None
    split, lowers = inner[0], [n.get("type") for n in (normal or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
    cut_out = split.get("invert") and split.get("behavior") == "Removed" and split.get("pattern") == {"Regex": _PUBLISHED}
    return "words" if lowers and cut_out else None


class Encoder:
    """``encode`` gives the ids of the library's ``encode(text, add_special_tokens=False)`` as little-endian integers of type ``code``."""

    def __init__(self, path: str, most: int = KEPT, code: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.path, self.most, self.code = path, most, np.dtype(code)
        self.library = None  # for whole texts; loaded when the first comes
        self.model = Tokenizer.from_file(path)
        steps = json.loads(self.model.to_str())
        suffix = steps.pop("model").get("end_of_word_suffix") or ""
        self.kind = _kind(steps)
        self.added = [t["content"] for t in steps.get("added_tokens", ())]
        if self.kind:
            self.model.normalizer = Sequence([])
            self.model.pre_tokenizer = CharDelimiterSplit(_BETWEEN)
            self.split = re.compile(_PIECES[self.kind]).findall
            self.table = _byte_table()
            names = self.model.get_vocab(with_added_tokens=False)
            self.spelt = np.zeros(max(names.values()) + 1, np.int64)  # characters of a piece that an id stands for
            self.spelt[list(names.values())] = [len(n.removesuffix(suffix) if suffix else n) for n in names]
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # lists of millions of strings make no cycles
        try:
            parts = [self._cut(t) for t in texts]
            if len(self.known) > self.most:
                self.known.clear()
            if new := set().union(*(p for p in parts if p is not None)).difference(self.known):
                self._learn(list(new))
            known = self.known.__getitem__
            return [self._whole(t) if p is None else b"".join(map(known, p)) for t, p in zip(texts, parts, strict=True)]
        finally:
            if collects:
                gc.enable()

    def _cut(self, text: str) -> list[str] | None:
        if not self.kind or any(a in text for a in self.added) or not _PLAIN.fullmatch(text):
            return None
        return self.split(text.lower() if self.kind == "words" else text)

    def _whole(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        (e,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(e.ids, self.code).tobytes()

    def _learn(self, new: list[str]) -> None:
        wide = self.code.itemsize
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            spelt = _BETWEEN.join(some).encode().decode("latin-1").translate(self.table)
            (e,) = self.model.encode_batch_fast([spelt], add_special_tokens=False)
            ids = np.array(e.ids, self.code)
            # Where a piece's characters are used up its ids end.
            reached = np.concatenate(([0], np.cumsum(self.spelt[ids])))
            wanted = np.cumsum([len(p) for p in spelt.split(_BETWEEN)])
            ends = np.searchsorted(reached, wanted)
            if ends[-1] != len(ids) or not np.array_equal(reached[ends], wanted):  # ids that do not spell the pieces
                self.known.update((p, self._whole(p)) for p in some)
                continue
            data, edges = ids.tobytes(), [0, *(wide * ends).tolist()]
            self.known.update((p, data[a:b]) for p, a, b in zip(some, edges, edges[1:], strict=False))


_ENCODERS: dict[tuple[str, int, str], Encoder] = {}


def encoder(path: str, most: int = KEPT, code: str = "<u4") -> Encoder:
    """One at a time in a worker process; Spark reuses its workers."""
    if (path, most, code) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, most, code] = Encoder(path, most, code)
    return _ENCODERS[path, most, code]


def release() -> None:
    """Gives a task's pieces back where a worker lives on to serve other operators; else the next task finds them, KEPT at most."""
    for held in _ENCODERS.values():
        held.known.clear()


def public_path(name: str) -> str:
    """Where a public vocabulary file lies, by the installed package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)
