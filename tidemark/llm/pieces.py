"""Whole texts as token ids by way of their distinct pieces: Arrow cuts a column, each distinct piece is encoded once, numpy gathers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import each

#: The normaliser and splitter (fixed values) under which a text may be cut at white space and behind an ASCII letter
#: that an ASCII mark follows: both end a pre-token, and no normalisation reaches across them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
BLANK = re.compile("[ \t\n\r\f\v]+")
WORD_END = r"([A-Za-z])([!-/:-@\[-`{-~])"
#: Characters of text that are worked on at once; a longer text is cut at blanks.
GROUP = 1 << 21
#: Bytes, about, of what a worker keeps in one cache, and the longest piece kept.
CACHE_BYTES, CACHE_PIECE = 48 << 20, 100


class Vocabulary:
    """A ``tokenizers`` file: the library's object, special tokens, token strings, and whether texts may be cut."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        plain = not any(t[k] for t in self.spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.cuts = self.spec["normalizer"] == NORMALIZER and self.spec["pre_tokenizer"] == SPLITTER and plain and not any(map(BLANK.search, self.added))
        longest_first = sorted(self.added, key=lambda t: -len(t))
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        names = {i: t for t, i in self.spec["model"]["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]


class Bounded(dict):
    """A cache by string that starts anew when its entries take about ``CACHE_BYTES``."""

    taken = 0

    def keep(self, made: dict[str, bytes]) -> None:
        self.taken += 200 * len(made) + 2 * sum(map(len, made)) + sum(map(len, made.values()))
        if self.taken > CACHE_BYTES:
            self.clear()
            self.taken = 0
        self.update(made if max(map(len, made), default=0) <= CACHE_PIECE else {n: i for n, i in made.items() if len(n) <= CACHE_PIECE})


class Pieces:
    """Ids of texts from those of their pieces.

    ``many`` gives the ids (little-endian unsigned 32-bit) of each of a list of pieces, ``whole`` those of a text that
    may hold special tokens, or of any text if the vocabulary's rules aren't those that texts are cut by.
    """

    def __init__(self, vocabulary: Vocabulary, many: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes]):
        self.vocabulary, self.many, self.whole = vocabulary, many, whole
        self.kept = Bounded()

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """``(row, ids)`` in the order of the rows: one or more for each row, whose ids follow each other."""
        rows, group, held = [], [], 0
        for row, text in enumerate(each(texts)):
            text, at = text or "", 0
            while self.vocabulary.cuts and len(text) - at > GROUP and (cut := BLANK.search(text, at + GROUP)):
                yield from self._group(rows, group)
                yield from self._group([row], [text[at : cut.end()]])
                rows, group, held, at = [], [], 0, cut.end()
            rows.append(row)
            group.append(text[at:])
            held += len(text) - at
            if held > GROUP:
                yield from self._group(rows, group)
                rows, group, held = [], [], 0
        yield from self._group(rows, group)

    def _group(self, rows: list[int], texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        if not rows:
            return
        special = np.zeros(len(rows), dtype=bool)
        column = pa.array(texts, pa.string())
        for token in self.vocabulary.added:  # in any case of letters, as pieces are lower-cased
            special |= np.asarray(pc.match_substring(column, token, ignore_case=True))
        if not self.vocabulary.cuts:
            special[:] = True
        if special.any():
            column = pc.if_else(pa.array(special), "", column)
        ids, ends = self._cut(column)
        start = 0
        for row, text, end, odd in zip(rows, texts, ends.tolist(), special.tolist(), strict=True):
            yield row, np.frombuffer(self.whole(text), "<u4") if odd else ids[start:end]
            start = end

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where each ends."""
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(column, WORD_END, r"\1 \2"))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        lower = pc.if_else(pc.string_is_ascii(distinct), pc.ascii_lower(distinct), distinct).dictionary_encode()
        found = self._ids(lower.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = np.asarray(lower.indices)[np.asarray(coded.indices)] if len(found) else np.zeros(0, np.int64)
        ids = np.frombuffer(b"".join(map(found.__getitem__, at.tolist())), "<u4")
        after = np.concatenate([[0], np.cumsum(lengths[at])])
        return ids, after[np.asarray(words.offsets)[1:] - words.offsets[0].as_py()]

    def _ids(self, names: list[str]) -> list[bytes]:
        found = [self.kept.get(n) for n in names]
        missing = [n for n, f in zip(names, found, strict=True) if f is None]
        if missing:
            made = dict(zip(missing, self.many(missing), strict=True))
            found = [made[n] if f is None else f for n, f in zip(names, found, strict=True)]
            self.kept.keep(made)
        return found
