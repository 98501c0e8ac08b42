"""BPE encoding by dynamic programming over prefixes, and decoding, for a ``tokenizers`` vocabulary file."""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import Bounded, Pieces, Vocabulary

#: Pieces of these characters need no normaliser but lower(): they are composed and map one to one.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ſ]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
#: Later than any merge.
NEVER = 1 << 40
#: Pairs of tokens whose compatibility a worker keeps.
PAIRS = 250_000
#: Added to the code of a word's last character, which the vocabulary marks with its suffix.
LAST = 0x1000
#: Ids, or tokens, that a digest turns into text at once.
SLICE = 1 << 16


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class PrefixEncoder:
    """Exact BPE without a merge loop.

    Every prefix of a word has one last token in its BPE encoding. Among the vocabulary's strings that end at a
    position (an Aho-Corasick automaton gives them, longest first), it is the one that is compatible with the last token of
    the prefix before it. Two tokens are compatible if no merge across their border comes earlier than the merges
    that use up its two sides. Back-pointers then give the whole encoding, in time linear in the word for bounded
    token lengths.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = {}, [-1] * size, [-1] * size
        self.formed = [-1] * size
        text: dict[int, str] = {}
        for t, i in vocab.items():
            if len(t) == 1:
                text[i] = t
            elif suffix and len(t) == 1 + len(suffix) and t.endswith(suffix):
                text[i] = chr(ord(t[0]) + LAST)
        for r, (a, b) in enumerate(pairs):
            a, b, i = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((a, b), r)
            if self.formed[i] < 0:
                self.left[i], self.right[i], self.formed[i], text[i] = a, b, r, text[a] + text[b]
        self.after: dict[int, dict[int, int]] = {}
        for (a, b), r in self.rank.items():
            self.after.setdefault(a, {})[b] = r
        self.ends, self.starts = [()] * size, [()] * size
        self.known: dict[int, bool] = {}
        self.mark = LAST if suffix else 0
        self.unknown = {c for c in map(chr, BYTE_LETTERS.values()) if c not in vocab or (suffix and c + suffix not in vocab)}
        if self.unknown:
            raise ValueError("the vocabulary lacks some single bytes")
        self.automaton = ahocorasick.Automaton()
        for i, t in text.items():
            if self.stands(i):  # other tokens never occur
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()

    def border(self, a: int, b: int) -> bool:
        """Whether the BPE encoding of the two tokens' joined strings is just these two tokens."""
        ends, starts = self.ends[a] or self.spine(a, self.right, self.ends), self.starts[b] or self.spine(b, self.left, self.starts)
        ok = not any((r := merges.get(y, NEVER)) < used_x and r <= used_y for merges, used_x in ends for y, used_y in starts)  # equal ranks merge from the left
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[a << 32 | b] = ok
        return ok

    def spine(self, token: int, side: list[int], kept: list) -> tuple:
        """Tokens at one border of a token's merge tree, from itself inwards, each with the rank of the merge that uses it up."""
        out, x, used = [], token, NEVER
        while x >= 0:
            if side is self.left:
                out.append((x, used))
            elif x in self.after:
                out.append((self.after[x], used))
            x, used = side[x], self.formed[x]
        kept[token] = tuple(out)
        return kept[token]

    def stands(self, i: int) -> bool:
        """Whether a token's own string encodes to it: nothing across the border of its two parts merges before them."""
        x, used_x = self.left[i], 1 << 40
        while x >= 0:
            y, used_y = self.right[i], 1 << 40
            while y >= 0:
                r = self.rank.get((x, y))
                if r is not None and r < used_x and r <= used_y and (x, y) != (self.left[i], self.right[i]):
                    return False
                y, used_y = self.left[y], self.formed[y]
            x, used_x = self.right[x], self.formed[x]
        return True

    def encode(self, word: str) -> list[int]:
        """Ids of one byte-level pre-token."""
        if self.mark:
            word = word[:-1] + chr(ord(word[-1]) + self.mark)
        n = len(word)
        last, size = (array("i", [k]) * (n + 1) if n > 1000 else [k] * (n + 1) for k in (-1, 0))
        known = self.known
        for end, (token, length) in self.automaton.iter(word):  # ends ascend; longest first at each end
            end += 1
            if last[end] >= 0:
                continue
            if length == end:
                last[end], size[end] = token, length
            elif (before := last[end - length]) >= 0:
                ok = known.get(before << 32 | token)
                if self.border(before, token) if ok is None else ok:
                    last[end], size[end] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]


class Codec:
    """Encodes and decodes whole texts; equal pieces are encoded once while they are kept."""

    _made: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.coder = PrefixEncoder(self.vocabulary.spec)
        self.known = Bounded()
        self.pieces = Pieces(self.vocabulary, lambda pieces: [self.plain(p) for p in pieces], self.whole)

    @classmethod
    def of(cls, path: str) -> "Codec":
        """One for each worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def pre_tokens(self, text: str) -> list[str]:
        """Byte-level pre-tokens of a text without special tokens."""
        v = self.vocabulary
        if v.cuts and PLAIN.fullmatch(text):
            found = WORDS.findall(text.lower())
            return found if text.isascii() else [w.encode().decode("latin-1").translate(BYTE_LETTERS) for w in found]
        if v.library.normalizer is not None:
            text = v.library.normalizer.normalize_str(text)
        return [w for w, _ in v.library.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = array("I", self.coder.encode(word)).tobytes()
            if len(word) < 8:  # longer ones seldom come in more than one piece
                self.known.keep({word: ids})
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.word, self.pre_tokens(text)))

    def whole(self, text: str) -> bytes:
        v = self.vocabulary
        parts = v.special.split(text) if v.special else [text]
        return b"".join(array("I", [v.added[p]]).tobytes() if p in v.added else self.plain(p) for p in parts if p)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return np.concatenate([ids for _, ids in self.pieces.slices(pa.array([text]))])

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        """The text of ids; a file without a decoder joins tokens by one space, so pieces but the first begin with one."""
        if self.vocabulary.spec["decoder"] is not None:
            return self.vocabulary.library.decode(ids.tolist(), skip_special_tokens=False)
        return ("" if first or not len(ids) else " ") + " ".join(map(self.vocabulary.names.__getitem__, ids.tolist()))

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Of each text: the number of its ids, and the SHA-256 of the ids as decimals and of the decoded text, both a slice at a time."""
        counts, coded, decoded = ([] for _ in range(3))
        pending: list[np.ndarray] = []  # a decoder needs all ids of a text
        for row, ids in self.pieces.slices(texts):
            if row == len(counts):
                counts.append(0)
                coded.append(hashlib.sha256())
                decoded.append(hashlib.sha256())
            if self.vocabulary.spec["decoder"] is not None:
                pending = [*pending, ids] if counts[row] else [ids]
                decoded[row] = hashlib.sha256(self.decode(np.concatenate(pending)).encode())
            for s in range(0, len(ids), SLICE):
                part, first = ids[s : s + SLICE], not counts[row]
                coded[row].update((("" if first else " ") + " ".join(map(str, part.tolist()))).encode())
                if self.vocabulary.spec["decoder"] is None:
                    decoded[row].update(self.decode(part, first).encode())
                counts[row] += len(part)
        return counts, [h.hexdigest() for h in coded], [h.hexdigest() for h in decoded]


def bpe_encode(text: Column, path: str) -> Column:
    """ARRAY<INT> of the text's ids; a null or empty text has none. The file must be readable on every executor."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        lengths, parts = np.zeros(len(texts), np.int64), [np.zeros(0, "<u4")]
        for row, ids in Codec.of(path).pieces.slices(texts):
            lengths[row] += len(ids)
            parts.append(ids)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view("<i4")))

    # else Spark would put the call into every expression that uses its result, and encode each text again for each
    return encode.asNondeterministic()(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """STRING of an array of ids; null and empty arrays give the empty text. Ids must be of the vocabulary, not null."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        codec = Codec.of(path)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        ends = np.cumsum(lengths)
        return pa.array([codec.decode(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.string())

    return decode(ids)


def bpe_digests(text: Column, path: str) -> Column:
    """STRUCT<n_tokens, ids_sha256, decoded_sha256> of a text encoded and decoded again, of which only digests leave the worker.

    A null or empty text has no ids and the digests of the empty string.
    """

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digest(texts: pa.Array) -> pa.Array:
        counts, coded, decoded = Codec.of(path).digests(texts)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest.asNondeterministic()(text)


def encode_table(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with its texts' ids and, if named, the decoded texts; columns of these names are replaced.

    Null and empty texts have no ids and decode to the empty text; texts are worked on in slices of about two million
    characters that end at blanks, and a longer text without blanks as one. Repeated rows stay, an empty table gives
    an empty one. The vocabulary's own normaliser and splitter are used; only if they are the known ones are texts cut
    into pieces first.
    """
    out = df.withColumn(ids_col, bpe_encode(F.col(text_col), path))
    return out if decoded_col is None else out.withColumn(decoded_col, bpe_decode(F.col(ids_col), path))
