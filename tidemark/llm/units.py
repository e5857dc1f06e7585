"""Pieces of text that byte-level tokenizers treat apart, and a bounded memo over them.

Both rank files and the byte-level ``.json`` split a text by one public pattern before any merge. A
text may be cut, without changing a single id, in front of every lone space or lone newline between
two characters that are not white space: no match of the pattern runs across such a place. The
pieces (here: units) repeat a lot, so each distinct unit is split by the full pattern once.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import public_tokenizers
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
#: White space other than the space and the newline, and the separator used below.
_OTHER_ASCII = "\t\x0b\x0c\r\0"
_OTHER = _OTHER_ASCII + "\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_DOUBLED = ("  ", "\n\n", " \n", "\n ")


def units(text: str) -> list[str]:
    """The text cut into units; joined they are the text again."""
    if not text:
        return []
    odd = text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _DOUBLED)
    if odd or any(x in text for x in (_OTHER_ASCII if text.isascii() else _OTHER)):
        return PATTERN.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def words(unit: str) -> list[str]:
    """The matches of the pattern; joined they are the unit again."""
    return PATTERN.findall(unit)


class LibraryMemo:
    """Ids of texts as the tokenizers library gives them, each distinct word encoded once.

    ``ids(texts)`` gives, for each text, its ids as little-endian unsigned 32-bit bytes. The memo
    holds at most ``limit`` units and is emptied beyond that, so memory is bounded; what is in it
    never changes a result. Special strings, which the library finds before it splits, are looked
    for in the whole text first; such a text goes to the library as a whole. A tokenizer that isn't
    byte-level always gets whole texts.
    """

    _open: dict[str, LibraryMemo] = {}

    def __init__(self, path: str, limit: int = 1_000_000):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.memo: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.apart = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
        self.special = [x["content"] for x in spec.get("added_tokens") or []]

    @classmethod
    def of(cls, path: str) -> LibraryMemo:
        """One memo for each Python worker and file; a reused worker keeps it."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_words(self, fresh: list[str]) -> None:
        """Fill in words, many to a call: behind a newline each where they don't start with a space."""
        import numpy as np

        spaced, bare, rest = [], [], []
        for w in fresh:
            if w[0] == " ":
                (spaced if len(w) > 1 and not w[1].isspace() else rest).append(w)
            else:
                (rest if w[0].isspace() else bare).append(w)
        for kind, lead, step in ((spaced, "", 1), (bare, "\n", 2)):
            for at in range(0, len(kind), 4096):
                part = kind[at : at + 4096]
                got = self.tokenizer.encode(lead + lead.join(part), add_special_tokens=False)
                of = np.array(got.word_ids, np.int64)
                if len(of) and of[-1] + 1 != step * len(part):  # never seen; the words would not line up
                    rest += part
                    continue
                ids = np.array(got.ids, "<u4").tobytes()
                starts = (4 * np.searchsorted(of, np.arange(step - 1, step * len(part) + step, step))).tolist()
                ends = (4 * np.searchsorted(of, np.arange(step, step * len(part) + step, step))).tolist()
                self.memo.update(zip(part, [ids[a:b] for a, b in zip(starts, ends)]))
        for w in rest:
            self.memo[w] = self._whole(w)

    def _learn(self, missing: Iterable[str]) -> None:
        fresh, split = set(), []
        for unit in missing:
            if unit.isalpha() or unit[0] == " " and unit[1:].isalpha():  # most units are a run of letters, which is one match
                fresh.add(unit)
            else:
                ws = words(unit)
                fresh.update(ws)
                if len(ws) > 1:
                    split.append((unit, ws))
        known = self.memo
        self._encode_words([w for w in fresh if w not in known])
        for unit, ws in split:
            known[unit] = known[ws[0]] + known[ws[1]] if len(ws) == 2 else b"".join([known[w] for w in ws])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            cut = [None if x is None else False if not self.apart or any(s in x for s in self.special) else units(x) for x in part]
            if len(self.memo) > self.limit:
                self.memo.clear()
            missing = set()
            for us in cut:
                if us:
                    missing.update(us)
            missing = [u for u in missing if u not in self.memo]
            if missing:
                self._learn(missing)
            out += [b"" if us is None else self._whole(x) if us is False else b"".join(map(self.memo.__getitem__, us)) for x, us in zip(part, cut)]
        return out
