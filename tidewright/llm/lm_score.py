"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens: lower-cased (A-Z) words, then one end. Two scores are given, both log10 probabilities of
that sequence: a smoothed unigram score of the tokens, and the mixing model's score of the tokens as bytes (a space after
each word, a line end for the end).

The model has two layers. First, the word contexts of the corpus: under each three words in a row (fewer at a text's
start), all training texts count which words follow. These counts grow with the corpus. They are never in one place: a
step of texts sends its distinct contexts with their next words, as 40 and 24 bits of hashes, to buckets of contexts, as
many as the corpus needs; a bucket adds them up and tells each step which of its words it would have predicted. Wherever
a text has such a context, the word that follows it most often (of several the one of the least code) is the prediction,
and one bit says whether the next word is the predicted one. The bit's probability is that of a counter chosen by whether
the prediction before was right and whether the training texts agree, which learns as the text goes on. A word predicted
right costs this bit, and the logarithm of how many words share a code on average. A training text is predicted from
contexts that other places have too, never from its own words alone.

Second, all other words are coded byte by byte, a byte as the bits of its Huffman code. Two predictors look up each bit
in tables of counts by hashed context (the last four bytes; the word so far); the counts come from all training texts.
Their logits are added with weights; a gate, whether the word so far was seen often enough at this bit, selects the word's
weight. The weights are refined after each bit by the error made, starting anew at every `BLOCK` bytes of a text, so any
split of the input gives the same scores. Bits per byte are the sum of -log2 of all bits' probabilities over the number of
bytes. The byte tables have a fixed size: they hold what letters follow one another, not what texts say.

Word counts, of hashed words, cover all training texts. The `FREQUENT` most frequent words' counts are sent to the
executors; those of all other words come from buckets as well, so nothing that grows with the vocabulary is copied.

The texts are read once to ask the buckets and once more to be scored, in the same steps: rows must come in the same order
whenever docs is read, as those of files do; if they don't, the query fails.

Defined cases: null and empty texts have the end token alone; rows that are alike are scored alike, each with a row of
its own; a null doc_id counts as the text "" for the split into training and held-out texts; without training texts all
counts are 0; a text of any length is scored whole, in a step of its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODES, LOWER, Spans, cut, mix, powers, ragged, signed, steps, table, utf8, words

FREQUENT, BLOCK, SYMBOLS = 524_288, 1_024, 64
CODE_BITS, FLUSH_WORDS = 24, 1_000_000
#: Keys that a bucket gets on average, at most.
BUCKET_KEYS = 1 << 20
COUNT_BYTES, SCORE_BYTES, PIECE, TILE, FAR = 1 << 18, 3 << 19, 1 << 13, 8, 9.0
#: Slots of each predictor's table, as a power of two.
SLOTS = (16, 18)
#: Right and all predictions that each counter starts with: (training texts disagree, agree) after (none, a right, a wrong) prediction.
COUNTERS = np.array([[1.0, 4.0], [3.6, 4.0], [0.6, 3.0], [3.0, 4.0], [9.8, 10.0], [1.2, 3.0]])
START, RATE, PRIOR, SURE = (0.3, 0.6, 0.6), 0.03, 0.1, 32
ADD = 0.1
_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def held_out(column: str = "doc_id"):
    return F.expr(f"crc32(cast(coalesce(cast({column} as string), '') as binary)) % 10 = 0")


def canonical(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as their lower-cased words, a space after each, and a line end."""
    white = _WHITE[data]
    n = len(data)
    last = np.zeros(n, bool)  # a word's last byte
    if n:
        last[:-1] = ~white[:-1] & white[1:]
        last[-1] = ~white[-1]
        inner = starts[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        last[inner - 1] = ~white[inner - 1]
    keep = ~white
    before = np.concatenate([[0], np.cumsum(keep.astype(np.int64) + last)])
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = before[:-1] + text
    out_starts = before[starts] + np.arange(len(starts))
    out = np.full(int(out_starts[-1]), 32, np.uint8)
    out[out_starts[1:] - 1] = 10
    out[at[keep]] = LOWER[data[keep]]
    return out, out_starts


class Code:
    """A Huffman code of the SYMBOLS - 1 most frequent bytes and an escape, as internal nodes and bits on the way to each symbol."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")[: SYMBOLS - 1]
        self.symbol = np.full(256, SYMBOLS - 1, np.uint8)
        self.symbol[order] = np.arange(SYMBOLS - 1)
        self.space = int(self.symbol[32])
        #: an escaped byte's own bits, by how often the corpus has it
        rare = np.where(self.symbol == SYMBOLS - 1, counts + 1.0, 0.0)
        self.escape_bits = np.where(rare > 0, -np.log2(np.maximum(rare, 1e-300) / rare.sum()), 0.0)
        weight = np.concatenate([counts[order], [counts.sum() - counts[order].sum()]]).astype(float) + 1e-3
        heap = [(w, s, s) for s, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        children, node = {}, SYMBOLS
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        left = [(node - 1, [])]
        while left:
            at, path = left.pop()
            if at < SYMBOLS:
                paths[at] = path
            else:
                for bit, child in enumerate(children[at]):
                    left.append((child, path + [(at - SYMBOLS, bit)]))
        self.size = np.array([len(paths[s]) for s in range(SYMBOLS)])
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.node = np.array([n for s in range(SYMBOLS) for n, _ in paths[s]], np.int64)
        self.sign = np.array([2 * b - 1 for s in range(SYMBOLS) for _, b in paths[s]], np.float32)
        #: below[bit][symbol, node]: whether the symbol lies on that side of the node
        self.below = np.zeros((2, SYMBOLS, SYMBOLS), np.float32)
        for s in range(SYMBOLS):
            for n, b in paths[s]:
                self.below[b, s, n] = 1


_CODES = (BYTE_CODES[1][:SYMBOLS] | _U(1)).copy()


def contexts(symbols: np.ndarray, starts: np.ndarray, space: int) -> list[np.ndarray]:
    """Each symbol's slot in each predictor's table. Contexts don't reach into the text before; no text is empty."""
    n = len(symbols)
    x = symbols.astype(np.uint32)
    four = np.zeros(n, np.uint32)
    for k in (1, 2, 3, 4):
        four[k:] |= x[:-k] << np.uint32(6 * (k - 1))
    for k in range(4):  # the first symbols of each text
        at = starts[:-1] + k
        at = at[at < starts[1:]]
        four[at] &= np.uint32((1 << 6 * k) - 1)
    four = (four * np.uint32(2654435761)) >> np.uint32(32 - SLOTS[0])
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[symbols] * up[:n], out=sums[1:])
    begin = np.zeros(n, np.int32)
    gaps = np.flatnonzero(symbols[:-1] == space) + 1
    begin[gaps] = gaps
    begin[starts[:-1]] = starts[:-1]
    begin = np.maximum.accumulate(begin)
    word = ((sums[:-1] - sums[begin]) * down[begin] * _U(0x9E3779B97F4A7C15)) >> _U(64 - SLOTS[1])
    return [four.astype(np.int32), word.astype(np.int32)]


OFFSETS = np.concatenate([[0], np.cumsum([SYMBOLS << b for b in SLOTS])])
BLOCK_ENTRIES = 1 << 14


def context_counts(texts: DataFrame, code: Code) -> np.ndarray:
    """How often each symbol follows each context, over all texts; one array of a fixed size.

    Each task sums its own texts and passes on blocks of the entries that are not 0, which Spark then adds by block.
    """

    def count(batches):
        total = np.zeros(int(OFFSETS[-1]), np.int32)
        waiting, size = [], 0

        def settle():
            for k in range(len(SLOTS)):  # sorted, as adding to one entry at a time is much slower
                entry = np.sort(np.concatenate([w[k] for w in waiting]))
                at = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
                total[entry[at]] += np.diff(np.append(at, len(entry))).astype(np.int32)

        for _, data, starts in steps(batches, most=COUNT_BYTES):
            data, starts = canonical(data, starts)
            symbols = code.symbol[data]
            waiting.append([slot * SYMBOLS + symbols + np.int32(OFFSETS[k]) for k, slot in enumerate(contexts(symbols, starts, code.space))])
            size += len(data)
            if size > 16 * COUNT_BYTES:
                settle()
                waiting, size = [], 0
        if waiting:
            settle()
        at = np.flatnonzero(total)
        cuts = np.searchsorted(at, np.arange(0, len(total) + BLOCK_ENTRIES, BLOCK_ENTRIES))
        for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if i < j:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([(at[i:j] % BLOCK_ENTRIES).astype("<u2").tobytes()], pa.binary()), pa.array([total[at[i:j]].astype("<i4").tobytes()], pa.binary())], ["block", "at", "n"])

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK_ENTRIES, np.int64)
        for batch in parts:
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8" if len(n) == 4 * len(at) else "<i4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([total[at].astype("<i8").tobytes()], pa.binary())], ["block", "at", "n"])

    shape = "block int, at binary, n binary"
    # in two steps, so that no task takes a block's parts from all tasks
    first = texts.mapInArrow(count, shape).withColumn("salt", F.spark_partition_id() % 32).groupBy("block", "salt").applyInArrow(add, shape)
    summed = first.groupBy("block").applyInArrow(add, shape)
    # at most OFFSETS[-1] entries of 4 bytes, whatever the size of the corpus
    out = np.zeros(int(math.ceil(OFFSETS[-1] / BLOCK_ENTRIES)) * BLOCK_ENTRIES, np.float32)
    for r in summed.toLocalIterator():
        out[r["block"] * BLOCK_ENTRIES + np.frombuffer(r["at"], "<u2").astype(np.int64)] = np.frombuffer(r["n"], "<i8")
    return out[: int(OFFSETS[-1])]


#: Units of a logit in the tables.
UNIT = 2048


def logits(counts: np.ndarray, code: Code) -> np.ndarray:
    """For each context and node the logit of the bit being 1, in 16 bits; the last of them tells whether the node was reached SURE times or more."""
    rows = counts.reshape(-1, SYMBOLS)
    out = np.zeros(rows.shape, np.int16)
    for a in range(0, len(rows), 8192):
        zero, one = rows[a : a + 8192] @ code.below[0], rows[a : a + 8192] @ code.below[1]
        value = np.rint(np.clip(np.log((one + PRIOR) / (zero + PRIOR)), -FAR, FAR) * UNIT).astype(np.int16)
        out[a : a + 8192] = (value & ~1) | (zero + one >= SURE)
    return out.reshape(-1)


def score_texts(data: np.ndarray, starts: np.ndarray, table_: np.ndarray, code: Code, keep: np.ndarray | None = None) -> np.ndarray:
    """log2 of the probability of each canonical text's bytes, or of those in keep, given all before them."""
    symbols = code.symbol[data]
    slots = contexts(symbols, starts, code.space)
    if keep is not None:
        before = np.concatenate([[0], np.cumsum(keep)])
        data, symbols, slots, starts = data[keep], symbols[keep], [slot[keep] for slot in slots], before[starts]
    n = len(data)
    slots = [slot.astype(np.int64) * SYMBOLS + OFFSETS[k] for k, slot in enumerate(slots)]
    # logits, negative where they speak for the bit that came; with the root of RATE in them, and out of the weights, no step has to multiply by it
    root = math.sqrt(RATE)
    signs = code.sign * np.float32(-root / UNIT)
    sizes = code.size[symbols]
    bit_at = np.concatenate([[0], np.cumsum(sizes)])
    # of each bit the word's logit where it isn't sure, where it is, and the other predictor's
    features = np.zeros((int(bit_at[-1]) + TILE, 3), np.float32)
    for i in range(0, n, PIECE):
        j = min(n, i + PIECE)
        own, out = sizes[i:j], features[bit_at[i] : bit_at[j]]
        inner = np.arange(len(out)) + np.repeat(code.first[symbols[i:j]] - bit_at[i:j] + bit_at[i], own)
        node, sign = np.take(code.node, inner), np.take(signs, inner)
        letters, word = (np.take(table_, np.repeat(slot[i:j], own) + node) for slot in slots)
        np.multiply(letters, sign, out=out[:, 2])
        sure = (word & 1).astype(np.float32)
        word = word * sign
        sure *= word
        out[:, 1] = sure
        np.subtract(word, sure, out=out[:, 0])
    # lanes: blocks of a text that start with fresh weights
    lengths = np.diff(starts)
    blocks = -(-lengths // BLOCK)
    lane_text = np.repeat(np.arange(len(lengths)), blocks)
    lane_start = starts[:-1][lane_text] + ragged(blocks) * BLOCK
    lane_end = np.minimum(lane_start + BLOCK, starts[1:][lane_text])
    a, b = bit_at[lane_start], bit_at[lane_end]
    order = np.argsort(a - b, kind="stable")
    at, left = a[order], (b - a)[order]
    lanes = len(order)
    weights = np.tile(np.array(START, np.float32)[:, None] / np.float32(root), (1, lanes))
    total, product = np.zeros(lanes), np.ones(lanes)
    longest = int(left.max(initial=0))
    alive = np.searchsorted(-left, -np.arange(longest + 1), "left").tolist()  # lanes that have ended are the last ones
    rows = np.lib.stride_tricks.sliding_window_view(features.reshape(-1), TILE * 3)[::3]
    for t in range(0, longest, TILE):
        # the next TILE bits of each lane, by step and feature
        live = alive[t]
        tile = np.ascontiguousarray(rows[at[:live] + t].T).reshape(TILE, 3, live)
        for step in range(min(TILE, longest - t)):
            live = alive[t + step]
            x, w = tile[step, :, :live], weights[:, :live]
            z = np.add.reduce(x * w, axis=0)
            np.exp(z, out=z)
            one = z + 1
            product[:live] *= one
            z /= one  # the probability of the other bit
            x *= z
            w -= x
        total -= np.log(product)
        product[:] = 1
    by_text = np.bincount(lane_text[order], total, len(lengths)) / math.log(2)
    rest = np.concatenate([[0.0], np.cumsum(code.escape_bits[data])])
    return by_text - (rest[starts[1:]] - rest[starts[:-1]])


_PLACES = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(3)], np.uint64)
END = _U(0x51ED270B1F4A7C15)


class Tokens:
    """The tokens of some texts, one after the other: each text's words, then its end. h: hashes, text: whose they are, place: where in the text, size: canonical bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        data = LOWER[data]
        begin, end, words_ = words(data, starts, _WHITE)
        texts = len(words_)
        self.count = words_ + 1
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.text = np.repeat(np.arange(texts), self.count)
        self.place = ragged(self.count)
        self.is_word = np.ones(len(self.text), bool)
        self.is_word[self.start[1:] - 1] = False
        self.h = np.full(len(self.text), END)
        self.h[self.is_word] = Spans(data).hash(begin, end)
        self.size = np.ones(len(self.text), np.int64)
        self.size[self.is_word] = end - begin + 1

    def codes(self) -> np.ndarray:
        return mix(self.h) >> _U(64 - CODE_BITS)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens but the first of a text, and their keys: the hash of the words before, and in its last CODE_BITS bits the token's code."""
        total = np.zeros(len(self.h), np.uint64)
        for k in (1, 2, 3):
            part = self.h[:-k] * _PLACES[k - 1]
            part[self.place[k:] < k] = 0
            total[k:] += part
        at = np.flatnonzero(self.place > 0)
        return at, mix(total[at]) >> _U(CODE_BITS) << _U(CODE_BITS) | self.codes()[at]


def corpus_counts(texts: DataFrame) -> DataFrame:
    """kind, x and n: how often each word's hash (kind 0) and each byte of the canonical texts (kind 1) occurs."""

    def count(batches):
        held, size, total = [], 0, np.zeros(256, np.int64)

        def settle():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int8)), pa.array(h), pa.array(n)], ["kind", "x", "n"])

        for _, data, starts in steps(batches):
            tokens = Tokens(data, starts)
            held.append(signed(tokens.h[tokens.is_word]))
            size += len(held[-1])
            own = np.bincount(data, minlength=256)
            own[97:123] += own[65:91]
            own[65:91] = own[_WHITE] = 0
            own[32], own[10] = len(held[-1]), len(starts) - 1
            total += own
            if size > 4 * FLUSH_WORDS:
                yield settle()
                held, size = [], 0
        if size:
            yield settle()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int8)), pa.array(at), pa.array(total[at])], ["kind", "x", "n"])

    return texts.mapInArrow(count, "kind tinyint, x long, n long").groupBy("kind", "x").agg(F.sum("n").alias("n"))


CONTEXTS, WORDS = 0, 1
#: What a bucket says of a context and the word after it: bits.
HIT, AGREED, SEEN, SEEN_AGAIN = 1, 2, 4, 8


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the bytes of their differences, all first bytes, then all second ones: the last ones are zeros, which a shuffle's compression drops."""
    return np.diff(keys, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8")[:, 0], dtype=np.uint64)


def packed_counts(n: np.ndarray) -> bytes:
    return n.astype("u1" if n.max() < 256 else "<u4").tobytes()


def asked(tokens: Tokens, train: np.ndarray, rare: np.ndarray):
    """For both kinds of keys the tokens that have one, the distinct keys, each token's place among them, and how often training texts have each. rare: which tokens are rare words."""
    at, keys = tokens.contexts()
    for at, keys in ((at, keys), (np.flatnonzero(rare), tokens.h[rare])):
        distinct, place = np.unique(keys, return_inverse=True)
        yield at, distinct, place, np.bincount(place[train[tokens.text[at]]], minlength=len(distinct))


def told(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's answers to each step: a byte of bits for each context and word, the count in 8 bytes for each rare word."""
    kind, bucket = key[0].as_py(), key[1].as_py()
    steps_, keys, counts = [], [], []
    for batch in parts:
        steps_ += batch.column("step").to_pylist()
        for raw, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist()):
            keys.append(unpacked_keys(raw))
            counts.append(np.frombuffer(n, "u1" if len(n) == len(keys[-1]) else "<u4"))
    every = np.sort(np.concatenate(keys))
    every = every[np.concatenate([[True], every[1:] != every[:-1]])]
    places = [np.searchsorted(every, own).astype(np.int32) for own in keys]
    del keys
    n = np.zeros(len(every), np.int64)
    for place, own in zip(places, counts):
        n[place] += own  # a step's keys are distinct
    if kind == CONTEXTS:
        context = every >> _U(CODE_BITS)
        new = np.concatenate([[True], context[1:] != context[:-1]])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        total, follow, most = np.add.reduceat(n, first), np.add.reduceat((n > 0).astype(np.int64), first), np.maximum.reduceat(n, first)
        best = np.minimum.reduceat(np.where(n == most[group], np.arange(len(n)), len(n)), first)
        state = (follow == 1) * AGREED + (total > 0) * SEEN + (total > 1) * SEEN_AGAIN
        answer = state[group]
        answer[best[total > 0]] += HIT
        answer = answer.astype(np.uint8)
    else:
        answer = n.astype("<i8")
    for i in range(0, len(places), 256):
        m = len(places[i : i + 256])
        said = pa.array([answer[place].tobytes() for place in places[i : i + 256]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(steps_[i : i + 256], pa.int64()), pa.array([kind] * m, pa.int32()), pa.array([bucket] * m, pa.int32()), said], ["step", "kind", "bucket", "said"])


def numbered(batches, most: int = SCORE_BYTES):
    """steps() with a number for each, which its place and its rows' k make up."""
    partition = TaskContext.get().partitionId()
    for i, (batch, data, starts) in enumerate(steps(batches, most=most)):
        k = batch.column("k").to_numpy().view(np.uint64)
        total = np.add.reduce(mix(k + np.arange(len(k), dtype=np.uint64)))
        yield int(signed(mix(np.array([int(total) ^ (partition << 32 | i)], np.uint64)))[0]), batch, data, starts


def match_bits(tokens: Tokens, said: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are predicted right, and the bits that saying so takes for each text. said: each token's answer. train: which texts are learnt from."""
    at = np.flatnonzero(said & np.where(train[tokens.text], SEEN_AGAIN, SEEN))
    hit, agreed = (said[at] & HIT) > 0, (said[at] & AGREED) > 0
    text = tokens.text[at]
    before = np.zeros(len(at), np.int64)
    before[1:] = np.where(text[1:] == text[:-1], np.where(hit[:-1], 1, 2), 0)
    state = before + 3 * agreed
    key = text * 6 + state
    order = np.argsort(key, kind="stable")
    first = np.ones(len(at), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    right = np.concatenate([[0], np.cumsum(hit[order])])
    seen = np.arange(len(at)) - begin
    p = (COUNTERS[state[order], 0] + right[:-1] - right[begin]) / (COUNTERS[state[order], 1] + seen)
    bits = np.empty(len(at))
    bits[order] = -np.log2(np.where(hit[order], p, 1 - p))
    out = np.zeros(len(tokens.h), bool)
    out[at] = hit
    return out, np.bincount(text, bits, len(tokens.count))


def score(docs: DataFrame, training=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, n_matched (tokens predicted right) and bits_per_byte of each row of docs (doc_id, text).

    training: a condition on the rows to learn from; by default those whose crc32 of the id is no multiple of 10.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out().alias("held_out"), F.xxhash64("doc_id", "text").alias("k"))
    rows = rows.withColumn("train", ~F.col("held_out") if training is None else training)
    learn = rows.where("train").select("text")
    n_texts = learn.count()
    counts = cut(corpus_counts(learn))
    words_ = counts.where("kind = 0").select(F.col("x").alias("w"), "n")
    total, distinct = words_.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = total + n_texts, distinct + (1 if n_texts else 0)  # with the ends
    most = words_.orderBy(F.desc("n"), "w").limit(FREQUENT).toArrow()
    order = np.argsort(most["w"].to_numpy())
    frequent, often = most["w"].to_numpy()[order], most["n"].to_numpy()[order]
    by_byte = np.zeros(256)
    for r in counts.where("kind = 1").collect():
        by_byte[r["x"]] = r["n"]
    code = Code(by_byte)
    tables = logits(context_counts(learn, code), code)
    scale = math.log10(tokens + ADD * (kinds + 1))
    shared_word = math.log2(1 + kinds / (1 << CODE_BITS))  # bits that tell words of one code apart
    known_words = spark.sparkContext.broadcast((frequent, often))
    shared = spark.sparkContext.broadcast((code, tables))
    del most, tables

    def find(h):
        """The place of each hash among the frequent words, and whether it is there."""
        frequent = known_words.value[0]
        at = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
        return at, frequent[at] == h if len(frequent) else np.zeros(len(h), bool)

    # a power of two, so that a bucket is a range of keys; a step's row to each bucket gets no smaller than the corpus needs
    bits = max(0, int(tokens // BUCKET_KEYS).bit_length())
    bounds = np.arange((1 << bits) + 1, dtype=object) << (64 - bits)
    bounds[-1] -= 1
    bounds = bounds.astype(np.uint64)

    def questions(t, train):
        rare = t.is_word & ~find(signed(t.h))[1]
        return asked(t, train, rare)

    def ask(batches):
        for step, batch, data, starts in numbered(batches):
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for kind, (_, keys, _, n) in enumerate(questions(Tokens(data, starts), train)):
                cuts = np.searchsorted(keys, bounds)
                cuts[-1] = len(keys)
                own = [(b, i, j) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if i < j]
                columns = [pa.array(x, type_) for x, type_ in (([step] * len(own), pa.int64()), ([kind] * len(own), pa.int32()), ([b for b, _, _ in own], pa.int32()), ([packed_keys(keys[i:j]) for _, i, j in own], pa.binary()), ([packed_counts(n[i:j]) for _, i, j in own], pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["step", "kind", "bucket", "keys", "n"])

    def bundle(batches):
        for step, batch, _, _ in numbered(batches):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([step], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["step", "rows"])

    answers = rows.mapInArrow(ask, "step long, kind int, bucket int, keys binary, n binary").groupBy("kind", "bucket").applyInArrow(told, "step long, kind int, bucket int, said binary")
    bundles = rows.mapInArrow(bundle, "step long, rows binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (code, tables), often = shared.value, known_words.value[1]
        log_n = np.log10(np.append(often, 0) + ADD)
        right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds_, said = right["kind"].to_pylist(), right["said"].to_pylist()
        said = {kind: b"".join(x for k, x in zip(kinds_, said) if k == kind) for kind in (CONTEXTS, WORDS)}
        out = []
        for body in left["rows"].to_pylist():
            batch = pa.ipc.open_stream(body).read_next_batch()
            data, starts = utf8(batch.column("text"))
            t = Tokens(data, starts)
            texts = len(t.count)
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            (at_c, keys_c, place_c, _), (at_w, keys_w, place_w, _) = questions(t, train)
            by_context, by_word = np.frombuffer(said[CONTEXTS], np.uint8), np.frombuffer(said[WORDS], "<i8")
            if len(by_context) != len(keys_c) or len(by_word) != len(keys_w):
                raise RuntimeError("the rows of docs came in another order when they were read again; write them first")
            answer = np.zeros(len(t.h), np.uint8)
            answer[at_c] = by_context[place_c]
            rare_n = by_word[place_w]
            at, is_known = find(signed(t.h))
            is_known &= t.is_word
            part = np.where(is_known, log_n[at], 0.0)
            part[at_w] = np.log10(rare_n + ADD)
            is_known[at_w] = rare_n > 0
            part[~t.is_word] = math.log10(n_texts + ADD)
            base = np.bincount(t.text, part, texts) - t.count * scale
            n_known = np.bincount(t.text, is_known, texts).astype(np.int64) + (1 if n_texts else 0)
            hit, bits = match_bits(t, answer, train)
            n_hit = np.bincount(t.text, hit, texts).astype(np.int64)
            text, cuts = canonical(data, starts)
            log2_p = score_texts(text, cuts, tables, code, np.repeat(~hit, t.size)) - bits - n_hit * shared_word
            size = np.diff(cuts)
            out.append(pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(t.count), pa.array(n_known), pa.array(np.full(texts, int(tokens))), pa.array(base), pa.array(log2_p * math.log10(2)), pa.array(size), pa.array(n_hit), pa.array(-log2_p / size)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "n_matched", "bits_per_byte"],
            ))
        return pa.Table.from_batches(out)

    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, n_matched long, bits_per_byte double"
    return bundles.groupBy("step").cogroup(answers.groupBy("step")).applyInArrow(run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
