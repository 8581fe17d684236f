"""Token counts under a byte-level BPE vocabulary, with a shortcut for pre-tokens that are one token.

The driver reads the tokenizer file once and proves, by running the merges on every vocabulary string, which of them
encode alone as one token (`whole_tokens`). Tasks split texts into pre-tokens; a pre-token among the proven strings counts
one without any merge, and only the others are merged, from the pair of lowest rank on, leftmost first. The different
ones of a step of texts are merged together, as rows of a matrix, and their counts kept in a table of bounded size. Nothing
is shuffled: each row needs the vocabulary alone, which is what is broadcast, and its size is that of the tokenizer file
whatever the number of texts.

Text is split as the library splits it. Where the pattern module's Unicode tables call letters or numbers what the
library's older tables don't, those characters (found by probing the library on the driver) are looked at as unassigned.

Special strings inside a text are one token each, as by the library's default; none is added, nothing is cut or padded.

Defined cases: a null or empty text has no tokens; a text of any length is counted whole, and one over LONG characters
pre-token by pre-token, so that its pre-tokens are never held together; bytes that aren't UTF-8 count as U+FFFD; repeated
rows are counted alike; an empty table gives no rows; further columns go through `count_tokens` unchanged, but for
those that have a name of its results, which are replaced. A tokenizer file of another kind is refused.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts_of, with_columns

FILE, LIMIT = "byte_bpe_50k.json", 512
#: Merged pre-tokens that a worker remembers, their longest length in bytes, and characters from which a text is split bit by bit.
REMEMBERED, SHORT, LONG = 1 << 19, 64, 1 << 20
_NONE = np.int32((1 << 31) - 1)  # the rank of a pair that isn't joined
_PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts below U+0240, whose UTF-8 bytes are all below 0xC9, with the classes written out.
_LETTERS, _NUMBERS, _SPACES, _NARROW = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u023f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0", 0xC9
_NARROW_PATTERN = rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
_UNASSIGNED = "͸"
_WHOLE = 1 << 32  # added to the count of a pre-token that took the shortcut


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the others for 256 and up, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def merged(raw: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The tokens of one pre-token: the adjacent pair of lowest rank is joined, the leftmost of equal ones first, until none has a rank."""
    n = len(raw)
    parts: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue  # one side has been joined with another part meanwhile
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (p := (parts[i], parts[after[i]])) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if (h := before[i]) >= 0 and (p := (parts[h], parts[i])) in ranks:
            heapq.heappush(heap, (ranks[p], h, p))
    return [p for p in parts if p is not None]


class Vocabulary:
    """What tasks need of a tokenizer file: ranks of pairs, the proven whole tokens, special strings, and characters to look at as unassigned."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take in what is beside them")
        byte = _bytes_of_letters()

        def raw(piece: str) -> bytes:
            return bytes(byte[c] for c in piece)

        pairs = [[raw(x) for x in (m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        ids = {raw(p): i for p, i in model["vocab"].items() if all(c in byte for c in p)}
        self.size = max(ids.values()) + 1
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        # a pair's key, its rank and the id of what it makes; the last entry answers for keys beyond all others
        self.keys, self.rank_of = np.append(keys[order], -1), np.append(order.astype(np.int32), _NONE)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.whole = self.whole_tokens(ids)
        self.odd = self._odd(path)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; an id below 0 is no token."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def merged_counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece, which are of SHORT bytes at most: rows of a matrix of ids, in which every row joins its pair of lowest rank at the same time."""
        counts, sizes = np.zeros(len(pieces), np.int64), np.array([len(p) for p in pieces], np.int64)
        for low, width in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 32), (32, SHORT)):
            row = np.flatnonzero((sizes > low) & (sizes <= width))
            if not len(row):
                continue
            padded = b"".join([pieces[i].ljust(width, b"\0") for i in row.tolist()])
            ids = self.byte_ids[np.frombuffer(padded, np.uint8).reshape(-1, width)]
            ids[np.arange(width) >= sizes[row][:, None]] = -1
            left = sizes[row]
            ranks = self.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(row), width - 1)
            while True:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(row)), at]
                live = best != _NONE
                counts[row[~live]] = left[~live]
                row = row[live]
                if not len(row):
                    break
                ids, ranks, at, left, best = ids[live], ranks[live], at[live], left[live] - 1, best[live]
                k, width = np.arange(len(row)), ids.shape[1] - 1
                ids = np.where(np.arange(width) > at[:, None], ids[:, 1:], ids[:, :-1])
                ids[k, at] = self.made[best]
                if width == 1:
                    counts[row] = left
                    break
                ranks = np.where(np.arange(width - 1) > at[:, None], ranks[:, 1:], ranks[:, :-1])
                r = at < width - 1
                ranks[k[r], at[r]] = self.look(ids[k[r], at[r]], ids[k[r], at[r] + 1])
                r = at > 0
                ranks[k[r], at[r] - 1] = self.look(ids[k[r], at[r] - 1], ids[k[r], at[r]])
        return counts

    def whole_tokens(self, strings) -> list[str]:
        """Those strings whose merges end in one token. A string that isn't UTF-8 by itself is no pre-token of a text."""
        short = [s for s in strings if len(s) <= SHORT]
        proven = [s for s, n in zip(short, self.merged_counts(short).tolist()) if n == 1]
        proven += [s for s in strings if len(s) > SHORT and len(merged(s, self.ranks)) == 1]
        found = []
        for s in proven:
            try:
                found.append(s.decode("utf-8"))
            except UnicodeDecodeError:
                pass
        return found

    @staticmethod
    def _odd(path: str) -> str:
        """Characters that the pattern module takes for letters or numbers and the library doesn't, as ranges of a set: between two marks, a character of another class than theirs is a pre-token of its own."""
        import regex
        from tokenizers import Tokenizer

        inner = regex.compile(r"[\p{L}\p{N}]")
        asked = [c for c in map(chr, (*range(128, 0xD800), *range(0xE000, 0x110000))) if inner.match(c)]
        probe = "!" + "!".join(asked) + "!"
        alone = {a for _, (a, b) in Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(probe) if b == a + 1}
        ranges: list[list[str]] = []
        for c in (c for k, c in enumerate(asked) if 2 * k + 1 not in alone):
            if ranges and ord(c) == ord(ranges[-1][1]) + 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return "".join(f"{a}-{b}" for a, b in ranges)


class Counter(dict):
    """Counts of pre-tokens: 1 + _WHOLE for proven whole tokens, the number of merged tokens for others, found when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.whole = vocabulary, dict.fromkeys(vocabulary.whole, 1 + _WHOLE)
        super().__init__(self.whole)
        self.most = len(self.whole) + REMEMBERED
        self.pattern, self.narrow = regex.compile(_PATTERN), re.compile(_NARROW_PATTERN)
        self.special = vocabulary.special
        self.at_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.odd = re.compile(f"[{vocabulary.odd}]") if vocabulary.odd else None

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8")
        return int(self.vocabulary.merged_counts([raw])[0]) if len(raw) <= SHORT else len(merged(raw, self.vocabulary.ranks))

    def learn(self, pieces: set[str]) -> None:
        """Merge those pieces that are short and not known, all at once."""
        new = [p for p in pieces if p not in self]
        raws = [p.encode("utf-8") for p in new]
        short = [k for k, r in enumerate(raws) if len(r) <= SHORT]
        if len(self) + len(short) > self.most:
            self.clear()
            self.update(self.whole)
            if len(new) < len(pieces):
                return self.learn(pieces)
        self.update(zip([new[k] for k in short], self.vocabulary.merged_counts([raws[k] for k in short]).tolist()))

    def pieces(self, text: str, narrow: bool):
        """The pre-tokens of a text without special strings: a list, or for a long text an iterator."""
        pattern, seen = self.narrow if narrow else self.pattern, text
        if not narrow and self.odd is not None and self.odd.search(text):
            seen = self.odd.sub(_UNASSIGNED, text)
        if len(text) > LONG or seen is not text:
            found = (text[m.start() : m.end()] for m in pattern.finditer(seen))
            return found if len(text) > LONG else list(found)
        return pattern.findall(text)

    def counts(self, raws: list[bytes]) -> list[tuple[int, int]]:
        """For each text (tokens, those of them that took the shortcut)."""
        split = []
        for raw in raws:
            text, narrow = raw.decode("utf-8", "replace"), raw.isascii() or int(np.frombuffer(raw, np.uint8).max()) < _NARROW
            parts = self.at_special.split(text) if any(s in text for s in self.special) else [text]
            split.append([self.pieces(p, narrow) for p in parts])
        self.learn(set().union(*[p for ps in split for p in ps if isinstance(p, list)]))
        out = []
        for parts in split:
            n = len(parts) - 1
            for part in parts:
                if isinstance(part, list):
                    n += sum(map(self.__getitem__, part))
                    continue
                while own := list(itertools.islice(part, LONG // 16)):
                    self.learn(set(own))
                    n += sum(map(self.__getitem__, own))
            out.append((n % _WHOLE, n // _WHOLE))
        return out


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_tokens and n_whole (tokens that needed no merge) of the text column. path: a byte-level BPE tokenizer file, read on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    made: list[Counter] = []

    def make(batch, data, starts):
        if not made:
            made.append(Counter(shared.value))
        found = made[0].counts(texts_of(data, starts))
        return {"n_tokens": pa.array([n for n, _ in found], pa.int64()), "n_whole": pa.array([w for _, w in found], pa.int64())}

    return with_columns(docs, make, [T.StructField("n_tokens", T.LongType()), T.StructField("n_whole", T.LongType())], text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
        "n_whole",
    )
