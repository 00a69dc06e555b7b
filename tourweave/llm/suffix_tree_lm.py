"""Language-model scores from a probabilistic suffix tree over words.

Tokens are a text's words (runs of anything but ASCII white space, ``A-Z`` lower-cased), then
one end.  The root of the tree is the unigram model ``(c + 1) / (N + V + 1)`` over all training
tokens.  A context is up to ``depth`` words before a token.  It is a candidate if training
tokens follow it ``MIN_COUNT`` times or more and the context without its first word is
a candidate too.  Its distribution is

    P(x | s) = (c(s x) + rest(s) * P(x | parent(s))) / (c(s) + PRIOR)

with ``parent(s)`` the context without its first word, c(s x) the counts of the kept
continuations (those that occur twice or more) and ``rest(s) = c(s) - (counts of its kept continuations) + PRIOR``, which sums to one.
A candidate stays in the tree only if its distribution diverges from its parent's: if the
mean log-likelihood gain on its own training tokens reaches ``MIN_GAIN``.  A token is scored by the
longest suffix of the words before it that stays.

How it is worked out.  Texts are turned into word ids once.  The ``HEAD_WORDS`` most frequent words are
broadcast, with all that are frequent in the sense below.  The ids of all others that occur twice or more come back, for each
chunk of the corpus, from the part that holds the word; contexts and continuations are made of all words alike.  A word that
occurs once is no kept continuation and in no candidate, so it needs no id, only its probability.  No group of tokens may be hot, so what is frequent is set apart; the scores are the same
wherever the line is drawn.  Frequent is what ``HOT_TOKENS`` tokens or more have, of training rows or not, or a
share of ``MIN_SHARE`` where that is more; so there are ``1 / MIN_SHARE`` frequent contexts a length at most.

* The trunk: frequent contexts and their frequent continuations.  It is broadcast.
* The tails: a token whose continuation is not frequent in a context of the trunk goes to the part of the corpus that
  holds the pair of its shortest such context and itself.  There the pair, and those of longer contexts of the
  trunk, are counted.  What a context of the trunk needs from its tails (how many tokens are kept
  continuations, what they gain) are sums a context.
* The branches: every token goes, with the words before it and its counts in the trunk, to the part that holds its
  shortest context outside the trunk.  A part grows its branches and scores its tokens; only sums
  a document and bundle of parts come back.  Branches grow with the corpus without a bound and are never gathered.

Edge cases: null text counts as empty (one end); a null ``doc_id`` counts as the empty text in
the training condition; repeated rows are learned from and scored once each; without training
documents every token has probability ``1 / (0 + 0 + 1)``, so scores are 0; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, cut, table, text_or_empty

DEPTH = 4
MIN_COUNT = 8
HEAD_WORDS = 1 << 18
PRIOR = 5.0
#: Mean gain in natural-log units that a context must bring.
MIN_GAIN = 0.02
#: Tokens that a part of the corpus should hold, and parts that tokens are dealt to at a time.
PART_TOKENS, FAN = 1 << 20, 4096
#: From how many tokens, and from which share, a context or continuation is frequent.
HOT_TOKENS, MIN_SHARE = PART_TOKENS, 1e-6
END = b""
_BITS, _WIDE = 20, 36  # ids of frequent words fit, those of all words
_BUCKET_BITS = 17  # words that a task looks up at a time
# what a worker holds at a time: tokens to count, tokens, keys, documents, bytes of words
_FLUSH, _CHUNK, _KEYS, _ROWS, _BYTES = 1 << 21, 1 << 19, 1 << 21, 256, 1 << 26
_BLOCK = 2048  # documents whose sums travel together
_BUNDLE = 2  # parts that a worker takes one after another, so that their sums travel as one
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NUMBERS, _WORDS, _READ = zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of all texts, one text after another, and how many each has."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(texts.view(pa.string())))
    # what is empty behind the last space is the end
    split = pc.ascii_split_whitespace(pc.if_else(pc.greater(pc.binary_length(low), 0), pc.binary_join_element_wise(low, "", " "), low))
    return split.flatten(), np.diff(split.offsets.to_numpy())


def _distinct(words: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and the place of each word among them."""
    chunks = pa.chunked_array(words, pa.string()).dictionary_encode().chunks
    return chunks[-1].dictionary, np.concatenate([c.indices.to_numpy() for c in chunks])


def _by_buckets(words: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """``(bucket, places, words)`` of distinct words, sorted in each bucket, joined and compressed."""
    order = pc.sort_indices(words).to_numpy()
    each = words.take(pa.array(order)).view(pa.binary()).to_numpy(zero_copy_only=False)
    bucket = np.fromiter(map(crc32, each), np.int64, len(each)) % buckets
    dealt = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[dealt], append=-1)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield int(bucket[dealt[a]]), order[dealt[a:b]], _WORDS.compress(b" ".join(each[dealt[a:b]]))


def _word_counts(marked: DataFrame) -> DataFrame:
    """``(word, all, n)``: how often the words of training rows occur in all rows and in those.  Counts travel sorted and compressed, by buckets of words."""
    buckets = 64 + marked.rdd.getNumPartitions() // 4

    def out(held: list[pa.Array], learn: list[np.ndarray]) -> pa.RecordBatch:
        words, at = _distinct(held)
        counts = [np.bincount(x, minlength=len(words)) for x in (at, at[np.concatenate(learn)])]
        bucket, packed, n = zip(*((b, joined, _pack(*(c[own] for c in counts))) for b, own, joined in _by_buckets(words, buckets)))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(packed, pa.binary()), pa.array(n, pa.binary())], ["bucket", "words", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, learn, size, weight = [], [], 0, 0
        for b in _slices(batches):
            words, sizes = _split(b.column("text"))
            held.append(words)
            learn.append(np.repeat(b.column("learn").to_numpy(zero_copy_only=False), sizes))
            size, weight = size + len(words), weight + words.nbytes
            if size >= _FLUSH or weight >= _BYTES:
                yield out(held, learn)
                held, learn, size, weight = [], [], 0, 0
        if held:
            yield out(held, learn)

    def add(bucket: pa.Table) -> pa.Table:
        words = [_joined(w) for w in bucket.column("words").to_pylist()]
        every, learned = (np.concatenate(c) for c in zip(*(_unpack(c, 2) for c in bucket.column("counts").to_pylist())))
        counted = pa.table([pa.chunked_array(words, pa.string()), pa.array(every), pa.array(learned)], ["word", "all", "n"]).group_by("word").aggregate([("all", "sum"), ("n", "sum")])
        counted = counted.filter(pc.greater(counted["n_sum"], 0))
        word = [c.view(pa.binary()) for c in counted["word"].chunks]
        return pa.table([pa.chunked_array(word, pa.binary()), counted["all_sum"], counted["n_sum"]], ["word", "all", "n"])

    counted = marked.mapInArrow(count, "bucket long, words binary, counts binary")
    return counted.groupBy("bucket").applyInArrow(add, "word binary, all long, n long")


def _joined(words: bytes) -> pa.Array:
    """Words that were joined by spaces and compressed."""
    return pc.split_pattern(pa.array([_READ.decompress(words)], pa.binary()).view(pa.string()), " ").flatten()


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in the sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, by bytes of the same weight, compressed; the first bytes are their widths."""
    widths = [max(1, -(-int(c.max(initial=0)).bit_length() // 8)) for c in columns]
    planes = [(c >> 8 * k).astype(np.uint8).tobytes() for c, width in zip(columns, widths) for k in range(width)]
    return bytes(widths) + _NUMBERS.compress(b"".join(planes))


def _unpack(packed: bytes, columns: int) -> list[np.ndarray]:
    widths = packed[:columns]
    planes, out = iter(np.frombuffer(_READ.decompress(packed[columns:]), np.uint8).reshape(sum(widths), -1)), []
    for width in widths:
        column = next(planes).astype(np.int64)
        for k in range(1, width):
            column |= next(planes).astype(np.int64) << 8 * k
        out.append(column)
    return out


def before(ids: np.ndarray, sizes: np.ndarray, depth: int, limit: int) -> np.ndarray:
    """For each token the ids of the 1st to ``depth``-th word before it; -1 from the first on that is none or not below ``limit``."""
    ids = np.where(ids < limit, ids, -1)
    out = np.full((depth, len(ids)), -1, np.int64)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for k in range(1, depth + 1):
        out[k - 1, k:] = ids[:-k] if k < len(ids) else ids[:0]
        out[k - 1, at < k] = -1
        if k > 1:
            out[k - 1, out[k - 2] < 0] = -1
    return out


@dataclass
class Vocabulary:
    """What ids say: those below ``head`` are words that are broadcast, those from there on follow each other by falling counts."""

    log_head: np.ndarray
    starts: np.ndarray  # where the other words' counts change
    logs: np.ndarray  # and the log probability from there on
    may: tuple[int, int, int]  # ids below the first, and from the second to below the third, may be in contexts

    def log(self, x: np.ndarray) -> np.ndarray:
        """Log probability by the root; 0 for what is -1."""
        out = np.where(x >= 0, self.log_head[np.minimum(x, len(self.log_head) - 1)], 0.0)
        if len(self.starts):
            other = x >= self.starts[0]
            out[other] = self.logs[np.searchsorted(self.starts, x[other], "right") - 1]
        return out

    def before(self, ids: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
        limit, first, end = self.may
        return before(np.where((ids < limit) | (ids >= first) & (ids < end), ids, -1), sizes, depth, end)


@dataclass
class Level:
    """The trunk's contexts of one length: key ``shorter context << 20 | first word``, sorted."""

    words: np.ndarray  # a row a context, the latest word first
    keys: np.ndarray
    counts: np.ndarray  # of training tokens
    next_keys: np.ndarray  # context << 20 | next word, sorted
    next_n: np.ndarray  # 0 unless kept
    rest: np.ndarray = field(default_factory=lambda: np.empty(0))
    keep: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    def entry(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Where the tokens ``x`` are among the frequent continuations, -1 if they are not."""
        return _find(self.next_keys, np.where((x >= 0) & (x < 1 << _BITS), s << _BITS | x, -1))


@dataclass
class Trunk:
    log_root: np.ndarray
    min_count: int
    levels: list[Level] = field(default_factory=list)
    vocabulary: Vocabulary | None = None

    def root(self, x: np.ndarray) -> np.ndarray:
        return np.where(x >= 0, self.log_root[x], 0.0) if self.vocabulary is None else self.vocabulary.log(x)

    def states(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """Level by level each token's context, -1 where it is not in the trunk."""
        state, alive = np.zeros(words.shape[1], np.int64), np.ones(words.shape[1], bool)
        for level, w in zip(self.levels, words):
            alive = alive & (w >= 0) & (w < 1 << _BITS)
            found = np.full(len(w), -1, np.int64)
            found[alive] = _find(level.keys, state[alive] << _BITS | w[alive])
            alive, state = found >= 0, found
            yield found

    def last(self, words: np.ndarray) -> np.ndarray:
        """Each token's context of the trunk's greatest length; 0, the empty one, while there are no levels."""
        state = np.zeros(words.shape[1], np.int64)
        for state in self.states(words):
            pass
        return state

    def candidates(self, words: np.ndarray) -> Iterator[tuple[Level, np.ndarray, np.ndarray]]:
        """Level by level the tokens that have a candidate, and which."""
        for level, state in zip(self.levels, self.states(words)):
            at = np.flatnonzero(state >= 0)
            at = at[level.counts[state[at]] >= self.min_count]
            yield level, at, state[at]

    def steps(self, words: np.ndarray, x: np.ndarray, seen: np.ndarray) -> Iterator[tuple[Level, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level: tokens, their candidates, the gain over the shorter context, and all log probabilities so far.
        ``seen`` has, a row a level, the counts of tails.  Unknown tokens go without the root's share."""
        log = self.root(x)
        for (level, at, s), counted in zip(self.candidates(words), seen):
            entry = level.entry(s, x[at])
            n = np.where(entry >= 0, level.next_n[entry] if len(level.next_n) else 0, counted[at])
            more = np.log(n / (level.counts[s] + PRIOR) * np.exp(-log[at]) + level.rest[s])
            log[at] += more
            yield level, at, s, more, log

    def walk(self, words: np.ndarray, x: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token the log probability by its longest candidate in the trunk, and that by the longest one that stays."""
        log = self.root(x)
        best = log.copy()
        for level, at, s, _, log in self.steps(words, x, seen):  # noqa: B007
            best[at] = np.where(level.keep[s], log[at], best[at])
        return log, best

    def reached(self, words: np.ndarray) -> np.ndarray:
        """How many words each token's longest context in the trunk has; -1 if that is no candidate, so that no longer one is."""
        out = np.zeros(words.shape[1], np.int64)
        for level, state in zip(self.levels, self.states(words)):
            at = np.flatnonzero((state >= 0) & (out >= 0))
            out[at] = np.where(level.counts[state[at]] >= self.min_count, out[at] + 1, -1)
        return out

    def tails(self, words: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A number for the token's shortest candidate in the trunk that lacks it among its frequent continuations, and the token; -1 if none does."""
        out = np.full(len(x), -1, np.int64)
        for k, (level, at, s) in enumerate(self.candidates(words)):
            free = (out[at] < 0) & (x[at] >= 0)
            pair = s[free] << _WIDE | x[at[free]]
            out[at[free]] = np.where(level.entry(s[free], x[at[free]]) < 0, pair * len(self.levels) + k, -1)
        return out

    def count_tails(self, words: np.ndarray, x: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """``seen`` for all tokens of a part: how often training tokens are the same continuation; 0 unless it is kept."""
        seen = np.zeros((len(self.levels), len(x)), np.int64)
        for row, (level, at, s) in zip(seen, self.candidates(words)):
            loose = level.entry(s, x[at]) < 0
            at, pair = at[loose], (s << _WIDE | x[at])[loose]
            place = np.unique(pair, return_inverse=True)[1]
            n = np.bincount(place[learn[at]], minlength=len(place))
            row[at] = np.where(n > 1, n, 0)[place]
        return seen

    def longer(self, next_keys: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(words, keys, counts)`` of the next level: a context and its continuation are a longer context, unless that is an end."""
        x = next_keys & ((1 << _BITS) - 1)
        words = self.levels[-1].words if self.levels else np.empty((1, 0), np.int64)
        new = np.concatenate([x[:, None], words[next_keys >> _BITS]], axis=1)[x != end]
        state = self.last(new.T)
        keys = state << _BITS | new[:, -1]
        order = np.argsort(keys)
        order = order[state[order] >= 0]
        return new[order], keys[order], n[x != end][order]

    def weigh(self, kept: list[np.ndarray]) -> None:
        """Set what each context leaves to the shorter one, given how many training tokens its tails keep."""
        for level, more in zip(self.levels, kept):
            own = np.bincount(level.next_keys >> _BITS, level.next_n, len(level.keys))[: len(level.keys)]
            level.rest = (np.maximum(level.counts - own - more, 0) + PRIOR) / (level.counts + PRIOR)

    def prune(self, learned: list[np.ndarray], gained: list[np.ndarray], frequent: list[np.ndarray]) -> None:
        """Decide which contexts stay, given the training tokens and the gains of their tails, and how often training tokens
        are their frequent continuations, kept or not.  What is left are unknown words."""
        shorter, log = None, None
        for level, tails, gain, n in zip(self.levels, learned, gained, frequent):
            own, x = level.next_keys >> _BITS, level.next_keys & ((1 << _BITS) - 1)
            # a frequent continuation is frequent in the shorter context too
            parent = self.log_root[x] if shorter is None else log[_find(shorter.next_keys, (level.keys[own] >> _BITS) << _BITS | x)]
            now = np.log(level.next_n / (level.counts[own] + PRIOR) + level.rest[own] * np.exp(parent))
            size = len(level.keys)
            unknown = np.maximum(level.counts - tails - np.bincount(own, n, size)[:size], 0)
            gain = gain + np.bincount(own, n * (now - parent), size)[:size] + unknown * np.log(level.rest)
            level.keep = (level.counts >= self.min_count) & (gain >= MIN_GAIN * level.counts)
            shorter, log = level, now


def branches(trunk: Trunk, words: np.ndarray, x: np.ndarray, learn: np.ndarray, seen: np.ndarray, min_count: int) -> np.ndarray:
    """What the branches add to each token's log score, given all tokens that share their first contexts outside the trunk."""
    (log, best), depth = trunk.walk(words, x, seen), trunk.reached(words)
    start, alive, own = best.copy(), np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for k, w in enumerate(words, 1):
        alive = alive & (w >= 0)
        if not alive.any():
            break
        # contexts of k words, numbered in this part
        own[alive] = np.unique(own[alive] << _WIDE | w[alive], return_inverse=True)[1]
        at = np.flatnonzero(alive & (depth < k))
        size = int(own[alive].max()) + 1
        c = np.bincount(own[at[learn[at]]], minlength=size).astype(np.float64)
        at = at[c[own[at]] >= min_count]
        alive = alive & (depth >= k)
        alive[at] = True
        if not len(at):
            continue
        s, known = own[at], x[at] >= 0
        pairs, place = np.unique(s[known] << _WIDE | x[at[known]], return_inverse=True)
        n = np.bincount(place[learn[at[known]]], minlength=len(pairs)).astype(np.float64)
        n[n < 2] = 0
        rest = (c - np.bincount(pairs >> _WIDE, n, size)[:size] + PRIOR) / (c + PRIOR)
        seen = np.zeros(len(at))
        seen[known] = n[place]
        new = np.log(seen / (c[s] + PRIOR) * np.exp(-log[at]) + rest[s])  # relative to the parent
        gain = np.bincount(s[learn[at]], new[learn[at]], size)[:size]
        log[at] += new
        best[at] = np.where(gain[s] >= MIN_GAIN * c[s], log[at], best[at])
    return best - start


def _part_of(words: np.ndarray, depth: np.ndarray, parts: int) -> np.ndarray:
    """The part of each token by its shortest context outside the trunk, which has ``depth + 1`` words; -1 if it has none or ``depth`` is -1."""
    mixed, fine = np.zeros(words.shape[1], np.uint64), (depth >= 0) & (depth < len(words))
    with np.errstate(over="ignore"):
        for k, w in enumerate(words):
            inside = depth >= k
            fine &= ~inside | (w >= 0)
            mixed = np.where(inside, (mixed ^ w.astype(np.uint64)) * _MIX, mixed)
            mixed ^= mixed >> np.uint64(29)
    return np.where(fine, (mixed % np.uint64(parts)).astype(np.int64), -1)


@dataclass
class Tokens:
    """Tokens with the words before them, their rows and their counts as tails; they travel as columns of small numbers."""

    words: np.ndarray
    x: np.ndarray
    learn: np.ndarray
    row: np.ndarray
    seen: np.ndarray

    def pack(self, at: np.ndarray | slice) -> bytes:
        step = np.diff(self.row[at], prepend=0)  # tokens are in the order of their documents
        ids = [*(self.words[:, at] + 1), self.x[at] + 1]
        others = _pack(self.learn[at].astype(np.int64), step & 0xFFFFFFFF, step >> 32 & 0xFFFFFFFF, *self.seen[:, at])
        # bytes of different weights are spread differently, so they are compressed apart
        packed = [_pack(*(c & 0xFF for c in ids)), _pack(*(c >> 8 & 0xFF for c in ids)), _pack(*(c >> 16 for c in ids)), others]
        return b"".join(len(p).to_bytes(4, "little") + p for p in packed)

    @staticmethod
    def of(packed: list[bytes], sizes: list[int], depth: int, levels: int) -> Tokens:
        n = sum(sizes)
        out = Tokens(np.empty((depth, n), np.int64), np.empty(n, np.int64), np.empty(n, bool), np.empty(n, np.int64), np.empty((levels, n), np.int64))
        ends = np.cumsum(sizes).tolist()
        for p, a, b in zip(packed, [0, *ends], ends):
            columns, at = [], 0
            for count in (*[depth + 1] * 3, 3 + levels):
                end = at + 4 + int.from_bytes(p[at : at + 4], "little")
                columns.append(_unpack(p[at + 4 : end], count))
                at = end
            for to, low, middle, high in zip([*out.words, out.x], *columns[:3]):
                np.subtract(low | middle << 8 | high << 16, 1, out=to[a:b])
            learn, low, high, *seen = columns[3]
            out.learn[a:b] = learn > 0
            np.cumsum(low | high << 32, out=out.row[a:b])
            for to, column in zip(out.seen, seen):
                to[a:b] = column
        return out


def _payloads(part: np.ndarray, t: Tokens) -> Iterator[tuple[int, int, int, bytes]]:
    """``(part, first row, tokens, packed columns)`` for each part."""
    small = part + 1 if part.max(initial=0) >= 65_535 else (part + 1).astype(np.uint16)  # these are sorted by digits
    order = np.argsort(small, kind="stable")
    order = order[np.searchsorted(small[order], 1) :]
    ends = np.flatnonzero(np.diff(part[order], append=-2)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        if b > a:
            yield int(part[order[a]]), int(t.row[order[a]]), b - a, t.pack(order[a:b])


_PAYLOAD = "part long, row long, n long, packed binary"


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    part, row, n, packed = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(row, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["part", "row", "n", "packed"])


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = _CHUNK, gaps: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Ids, sizes and training marks of some rows that follow each other (unless ``gaps`` are fine), and the number of the first."""
    ids, sizes, learn, first, held, expected = [], [], [], 0, 0, -1
    for b in batches:
        for row, marked, packed in zip(*(b.column(c).to_pylist() for c in ("row", "learn", "ids"))):
            if ids and (held >= limit or (row != expected and not gaps)):
                yield np.concatenate(ids), np.array(sizes), np.array(learn, bool), first
                ids, sizes, learn, held = [], [], [], 0
            first = first if ids else row
            expected = row + 1
            ids.append(_unpack(packed, 1)[0] - 1)
            sizes.append(len(ids[-1]))
            learn.append(marked)
            held += sizes[-1]
    if ids:
        yield np.concatenate(ids), np.array(sizes), np.array(learn, bool), first


def _count_level(coded: DataFrame, trunk, least: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The continuations of the trunk's last level with at least ``least`` tokens: sorted keys and training tokens.
    ``common`` are the words that have as many; no other word is frequent behind a context."""
    may = np.isin(np.arange(int(common.max(initial=0)) + 2), common)  # the last one stands for all greater ids

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(n.astype(np.int64)), pa.array(n * (key & 1))], ["key", "n", "learned"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = trunk.value, [], 0
        for ids, sizes, learn, _ in _chunks(batches, gaps=True):
            state = model.last(model.vocabulary.before(ids, sizes, len(model.levels)))
            at = np.flatnonzero((state >= 0) & (ids >= 0) & may[np.minimum(ids, len(may) - 1)])
            held.append((state[at] << _BITS | ids[at]) << 1 | np.repeat(learn, sizes)[at])
            size += len(at)
            if size >= _KEYS:
                yield out(held)
                held, size = [], 0
        yield out(held)

    counted = coded.select("row", "learn", "ids").mapInArrow(run, "key long, n long, learned long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"))
    got = counted.where(F.col("n") >= least).toPandas().sort_values("key")
    return got["key"].to_numpy(np.int64), got["learned"].to_numpy(np.int64)


def _head_least(unigrams: DataFrame) -> float:
    """From which count on words are broadcast, ``HEAD_WORDS`` of them at most, from a histogram by quarters of octaves."""
    by_size = unigrams.groupBy(F.floor(F.log2("all") * 4).alias("q")).count().orderBy(F.desc("q")).collect()  # some 250 rows at most
    held, least = 0, 1.0
    for r in by_size:
        held += r["count"]
        if held > HEAD_WORDS:
            return 2 ** ((r["q"] + 1) / 4)
    return least


def _numbered(words: DataFrame, first: int) -> tuple[DataFrame, list]:
    """``(word, id)`` with the numbers from ``first`` on by falling counts, and how many words have each count."""
    placed = cut(words.orderBy(F.desc("n"), "word").select("word", "n", F.monotonically_increasing_id().alias("at")))
    placed = placed.select("word", "n", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at"))
    ranges = placed.groupBy("range").count().orderBy("range").collect()  # a row a partition
    ends = first + np.cumsum([r["count"] for r in ranges])
    offsets = words.sparkSession.createDataFrame([(r["range"], int(end) - r["count"]) for r, end in zip(ranges, ends)], "range long, offset long")
    runs = placed.groupBy("n").count().orderBy(F.desc("n")).collect()  # these words are the rarer ones, so there are few counts
    return placed.join(F.broadcast(offsets), "range").select("word", (F.col("offset") + F.col("at")).alias("id")), runs


def _coded(rows: DataFrame, train: Column, words: list[bytes], others: DataFrame, vocabulary: Vocabulary, total: int, distinct: int) -> DataFrame:
    """Texts as ids, numbered.  A chunk of documents asks once for each of its words that is not broadcast, a bucket of words at a time,
    and numbers them in that order; in questions ``row`` is the first one's number.  ``others`` has their ids, or -1 for words that occur once."""
    head, buckets = len(words), 1 + (distinct >> _BUCKET_BITS)
    context = rows.sparkSession.sparkContext
    lookup, shipped = context.broadcast({w: i for i, w in enumerate(words)}), context.broadcast(vocabulary)

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in _CODED], [k for k, _ in _CODED])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size, weight = lookup.value, [], 0, 0

        def chunk() -> Iterator[pa.RecordBatch]:
            number, (found, at) = held[0][0].column("row")[0].as_py(), _distinct([words for _, words, _ in held])
            each = found.view(pa.binary()).to_numpy(zero_copy_only=False)
            ids = np.fromiter(map(place.get, each, repeat(-1)), np.int64, len(each))
            asked, first, rows = np.flatnonzero(ids < 0), 0, []
            for bucket, own, joined in _by_buckets(found.take(pa.array(asked)), buckets):
                ids[asked[own]] = head + first + np.arange(len(own))
                rows.append((bucket, first, joined))
                first += len(own)
            sizes = np.concatenate([n for _, _, n in held])
            packed = iter([_pack(x) for x in np.split(ids[at], np.cumsum(sizes)[:-1])])
            for b, _, n in held:
                yield batch(len(n), chunk=pa.array([number] * len(n), pa.int64()), ids=pa.array([next(packed) for _ in n], pa.binary()), **{c: b.column(c) for c in ("row", "doc_id", "learn")})
            bucket, first, joined = zip(*rows) if rows else ((), (), ())
            yield batch(len(rows), chunk=pa.array([number] * len(rows), pa.int64()), row=pa.array(first, pa.int64()), bucket=pa.array(bucket, pa.int64()), words=pa.array(joined, pa.binary()))

        for b in _slices(batches):
            words, sizes = _split(b.column("text"))
            held.append((b.select(["row", "doc_id", "learn"]), words, sizes))
            size, weight = size + len(words), weight + words.nbytes
            if size >= _CHUNK * 3 // 2 or weight >= _BYTES:
                yield from chunk()
                held, size, weight = [], 0, 0
        if held:
            yield from chunk()

    def answer(questions: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        place, out = dict(zip(known["word"], known["id"])), []
        for asked in questions["words"]:
            split = _joined(asked).view(pa.binary()).to_numpy(zero_copy_only=False)
            out.append(_pack(np.fromiter(map(place.get, split, repeat(-2)), np.int64, len(split)) + 2))
        return pd.DataFrame({"chunk": questions["chunk"], "first": questions["row"], "found": out})

    def fill(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("row")
        # the words of a chunk are numbered as they are asked for
        answers = answers.sort_by("first")
        found = np.concatenate([np.empty(0, np.int64), *(_unpack(f, 1)[0] - 2 for f in answers["found"].to_pylist())])
        each = [_unpack(p, 1)[0] for p in docs["ids"].to_pylist()]
        sizes, ids = np.array([len(x) for x in each], np.int64), np.concatenate(each)
        asked = ids >= head
        ids[asked] = found[ids[asked] - head]
        starts = np.cumsum(sizes) - sizes
        known, more = ids > -2, np.add.reduceat(np.where(ids < 0, np.log10(np.where(ids == -1, 2, 1) / (total + distinct + 1)), 0.0), starts)
        ids = np.maximum(ids, -1)
        base = np.add.reduceat(shipped.value.log(ids), starts) / np.log(10) + more
        packed = [_pack(x + 1) for x in np.split(ids, starts[1:])]
        columns = [sizes, np.add.reduceat(known.astype(np.int64), starts), base, more, pa.array(packed, pa.binary())]
        return pa.table([*(docs[c] for c in ("row", "doc_id", "learn")), *map(pa.array, columns)], ["row", "doc_id", "learn", "n_tokens", "n_known", "base_score", "more", "ids"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(train, F.lit(False)).alias("learn"), "text")
    # the partitions are files from here on, so the numbers are stable
    asked = cut(numbered.mapInArrow(encode, "chunk long, row long, doc_id long, learn boolean, ids binary, bucket long, words binary"))
    questions = asked.where("bucket IS NOT NULL").select("chunk", "bucket", "row", "words").groupBy("bucket")
    known = others.withColumn("bucket", F.crc32("word") % buckets).groupBy("bucket")
    answers = questions.cogroup(known).applyInPandas(answer, "chunk long, first long, found binary").groupBy("chunk")
    docs = asked.where("bucket IS NULL").select("chunk", "row", "doc_id", "learn", "ids").groupBy("chunk")
    return cut(docs.cogroup(answers).applyInArrow(fill, "row long, doc_id long, learn boolean, n_tokens long, n_known long, base_score double, more double, ids binary"))


_CODED = [("chunk", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("ids", pa.binary()), ("bucket", pa.int64()), ("words", pa.binary())]


def _free(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that nothing refers to go now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, part_tokens: int = PART_TOKENS, fan: int = FAN, hot_tokens: int = HOT_TOKENS
) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``, a row per row of ``docs``; log10."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    marked = docs.select(text_or_empty(text_col).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("learn"))
    unigrams = cut(_word_counts(marked))
    sums = unigrams.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("all").alias("all")).first()
    total, distinct = sums["total"] or 0, sums["distinct"]
    # what is frequent is broadcast, however many words are before it
    head_least = min(_head_least(unigrams), max(min_share * (sums["all"] or 0), min_count, hot_tokens))
    head = unigrams.where(F.col("all") >= head_least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, counts, everywhere = head["word"].map(bytes).tolist(), head["n"].to_numpy(np.int64), head["all"].to_numpy(np.int64)
    others = unigrams.where(F.col("all") < head_least)
    numbers, runs = _numbered(others.where("n > 1"), len(words))
    of_run, learned_run = np.array([r["count"] for r in runs], np.int64), np.array([r["n"] for r in runs], np.int64)
    vocabulary = Vocabulary(
        np.log(np.append((counts + 1) / (total + distinct + 1), 1.0)),
        len(words) + np.cumsum(of_run) - of_run,
        np.log((learned_run + 1) / (total + distinct + 1)),
        # no candidate holds a word that is rarer
        (int((counts >= min_count).sum()), len(words), len(words) + int(of_run[learned_run >= min_count].sum())),
    )
    coded = _coded(rows, train, words, numbers.unionByName(others.where("n = 1").select("word", F.lit(-1).cast("long").alias("id"))), vocabulary, total, distinct)
    del unigrams, others, numbers
    _free(docs.sparkSession)

    all_tokens = coded.agg(F.sum("n_tokens")).first()[0] or 0
    least = max(min_share * all_tokens, min_count, hot_tokens)
    parts = max(1, -(-all_tokens // part_tokens))
    trunk, frequent = Trunk(vocabulary.log_head[:-1], min_count, vocabulary=vocabulary), []
    end = words.index(END) if END in words else -1  # nothing follows an end
    next_keys = common = np.flatnonzero(everywhere >= least)
    learned = counts[next_keys]
    for _ in range(depth):
        contexts, keys, learned = trunk.longer(next_keys, learned, end)
        if not len(keys):
            break
        trunk.levels.append(Level(contexts, keys, learned, *(np.empty(0, np.int64),) * 2))
        next_keys, learned = _count_level(coded, context.broadcast(trunk), least, common)
        trunk.levels[-1].next_keys, trunk.levels[-1].next_n = next_keys, np.where(learned > 1, learned, 0)
        frequent.append(learned)

    plain = coded.select("row", "learn", "ids")
    tails = None
    if trunk.levels:
        counted = context.broadcast(trunk)

        def place_tails(t: Tokens) -> np.ndarray:
            return _mixed_parts(counted.value.tails(t.words, t.x), parts)

        def count(payloads: pd.DataFrame) -> pd.DataFrame:
            t = _gathered(payloads, depth, 0)
            t.seen = counted.value.count_tails(t.words, t.x, t.learn)
            spans = [slice(a, a + _CHUNK) for a in range(0, len(t.x), _CHUNK)]
            return pd.DataFrame({"n": [len(t.x[span]) for span in spans], "packed": [t.pack(span) for span in spans]})

        tails = cut(_dealt([(plain, _coded_tokens(depth, 0, counted), place_tails)], depth, 0, parts, fan).groupBy("part").applyInPandas(count, "n long, packed binary"))
        # sums for each context of the trunk, of which there are 1 / min_share a length at most
        kept, learned_tails = _context_sums(tails, counted, depth, _kept_tails, 2)
        trunk.weigh(kept)
        (gained,) = _context_sums(tails, context.broadcast(trunk), depth, _gained_tails, 1)
        trunk.prune(learned_tails, gained, frequent)
        _free(docs.sparkSession)
    shipped, levels = context.broadcast(trunk), len(trunk.levels)

    def by_trunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for ids, each, _, first in _chunks(batches):
            context = model.vocabulary.before(ids, each, depth)
            _, best = model.walk(context, ids, np.zeros((levels, len(ids)), np.int64))
            best[model.tails(context, ids) >= 0] = 0
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(each))), pa.array(np.add.reduceat(best, np.cumsum(each) - each) / np.log(10))], ["row", "score_head"])

    def by_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _packed_tokens(depth, levels)(batches):
            yield pa.RecordBatch.from_pandas(_document_sums(t.row, shipped.value.walk(t.words, t.x, t.seen)[1], 0), preserve_index=False)

    def place_branches(t: Tokens) -> np.ndarray:
        return _part_of(t.words, shipped.value.reached(t.words), parts)

    def place_others(t: Tokens) -> np.ndarray:
        return np.where(shipped.value.tails(t.words, t.x) < 0, place_branches(t), -1)

    def grow(payloads: pd.DataFrame) -> pd.DataFrame:
        rows, sums = [], []
        for _, part in payloads.groupby("part"):
            t = _gathered(part, depth, levels)
            row, more = _changed(t.row, branches(shipped.value, t.words, t.x, t.learn, t.seen, min_count))
            rows.append(row)
            sums.append(more)
            del t
        return _document_sums(np.concatenate(rows), np.concatenate(sums), int(payloads["part"].min()))

    pieces = [] if tails is None else [tails.mapInArrow(by_tails, _SUMS)]
    if least > min_count:
        sources = [(plain, _coded_tokens(depth, levels, shipped), place_others)] + ([] if tails is None else [(tails, _packed_tokens(depth, levels), place_branches)])
        pieces.append(_dealt(sources, depth, levels, parts, fan).groupBy(F.floor(F.col("part") / _BUNDLE).alias("bundle")).applyInPandas(grow, _SUMS))
    scored = plain.mapInArrow(by_trunk, "row long, score_head double")
    for piece in pieces:
        # sums of many documents travel in blocks of documents, not as a row for each document and part
        scored = scored.unionByName(piece.groupBy("block").applyInPandas(_add_up, "row long, score_head double"))
    scored = scored.groupBy("row").agg(F.sum("score_head").alias("score_head"))

    return coded.select("row", "doc_id", "n_tokens", "n_known", "base_score", "more").join(scored, "row").select(
        "doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("score_head") + F.col("more")).alias("score")
    )


_SUMS = "block long, part long, packed binary, sums binary"


def _mixed_parts(key: np.ndarray, parts: int) -> np.ndarray:
    """A part for each key that is not negative, -1 for the others."""
    with np.errstate(over="ignore"):
        mixed = key.astype(np.uint64) * _MIX
    return np.where(key >= 0, ((mixed ^ mixed >> np.uint64(29)) % np.uint64(parts)).astype(np.int64), -1)


def _coded_tokens(depth: int, levels: int, trunk):
    """Reads tokens of coded texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
        for ids, each, learn, first in _chunks(batches):
            row = first + np.repeat(np.arange(len(each)), each)
            yield Tokens(trunk.value.vocabulary.before(ids, each, depth), ids, np.repeat(learn, each), row, np.zeros((levels, len(ids)), np.int64))

    return read


def _packed_tokens(depth: int, levels: int):
    """Reads tokens that have travelled."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
        held, sizes = [], []
        for b in batches:
            for packed, n in zip(b.column("packed").to_pylist(), b.column("n").to_pylist()):
                held.append(packed)
                sizes.append(n)
                if sum(sizes) >= _CHUNK:
                    yield Tokens.of(held, sizes, depth, levels)
                    held, sizes = [], []
        if held:
            yield Tokens.of(held, sizes, depth, levels)

    return read


def _gathered(payloads: pd.DataFrame, depth: int, levels: int) -> Tokens:
    """All tokens of a part, in an order that does not depend on arrival."""
    payloads = payloads.sort_values(["row", "n"], kind="stable")
    return Tokens.of(payloads["packed"].tolist(), payloads["n"].tolist(), depth, levels)


def _dealt(sources: list[tuple], depth: int, levels: int, parts: int, fan: int) -> DataFrame:
    """``(part, row, n, packed)`` of the tokens of ``sources`` (table, reader, part of each token), at most ``fan`` parts at a time."""
    wide = max(1, -(-parts // fan))

    def dealer(read, place, width: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in read(batches):
                part = place(t)
                yield _batch(list(_payloads(np.where(part >= 0, part // width, -1), t)))

        return deal

    out = None
    for source, read, place in sources:
        dealt = source.mapInArrow(dealer(read, place, wide), _PAYLOAD)
        if wide > 1:  # from coarse parts to the parts themselves
            dealt = dealt.repartition("part").mapInArrow(dealer(_packed_tokens(depth, levels), place, 1), _PAYLOAD)
        out = dealt if out is None else out.unionByName(dealt)
    return out


def _kept_tails(model: Trunk, t: Tokens) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Level by level the contexts of training tokens that are tails there; 1 if the continuation is kept, and 1."""
    for seen, (level, at, s) in zip(t.seen, model.candidates(t.words)):
        loose = t.learn[at] & (level.entry(s, t.x[at]) < 0)
        yield s[loose], [(seen[at[loose]] > 0).astype(np.float64), np.ones(int(loose.sum()))]


def _gained_tails(model: Trunk, t: Tokens) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Level by level the contexts of training tokens that are tails there, and what each gains over the shorter context."""
    for level, at, s, more, _ in model.steps(t.words, t.x, t.seen):
        loose = t.learn[at] & (level.entry(s, t.x[at]) < 0)
        yield s[loose], [more[loose]]


def _context_sums(tails: DataFrame, trunk, depth: int, terms, values: int) -> list[list[np.ndarray]]:
    """For each of the values that ``terms`` yields, level by level its sum for each context of the trunk."""
    sizes = [len(level.keys) for level in trunk.value.levels]
    names = [f"v{i}" for i in range(values)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((values, n)) for n in sizes]
        for t in _packed_tokens(depth, len(sizes))(batches):
            for total, (s, each) in zip(sums, terms(trunk.value, t)):
                for row, v in zip(total, each):
                    row += np.bincount(s, v, len(row))
        for k, total in enumerate(sums):
            found = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k)), pa.array(found), *(pa.array(row[found]) for row in total)], ["level", "context", *names])

    schema = ", ".join(["level long, context long", *(f"{n} double" for n in names)])
    got = tails.mapInArrow(run, schema).groupBy("level", "context").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    out = [[np.zeros(n) for n in sizes] for _ in names]
    for k, rows in got.groupby("level"):
        for sums, n in zip(out, names):
            sums[k][rows["context"].to_numpy()] = rows[n].to_numpy()
    return out


def _changed(row: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that there is something for, and their sums."""
    changed = more != 0
    found, place = np.unique(row[changed], return_inverse=True)
    return found, np.bincount(place, more[changed], len(found))


def _document_sums(row: np.ndarray, more: np.ndarray, part: int) -> pd.DataFrame:
    """Sums for each document that there is something for, in blocks of documents."""
    found, sums = _changed(row, more)
    block = found // _BLOCK
    ends = np.flatnonzero(np.diff(block, append=-1)) + 1
    spans = list(zip([0, *ends[:-1].tolist()], ends.tolist())) if len(found) else []
    return pd.DataFrame(
        {
            "block": pd.Series([int(block[a]) for a, _ in spans], dtype="int64"),
            "part": pd.Series([part] * len(spans), dtype="int64"),
            "packed": [_pack(found[a:b] % _BLOCK) for a, b in spans],
            "sums": [sums[a:b].tobytes() for a, b in spans],
        }
    )


def _add_up(payloads: pd.DataFrame) -> pd.DataFrame:
    payloads = payloads.sort_values("part", kind="stable")
    doc = np.concatenate([_unpack(p, 1)[0] for p in payloads["packed"]])
    total = np.bincount(doc, np.frombuffer(b"".join(payloads["sums"])), _BLOCK)
    found = np.flatnonzero(np.bincount(doc, minlength=_BLOCK))
    return pd.DataFrame({"row": found + int(payloads["block"].iloc[0]) * _BLOCK, "score_head": total[found] / np.log(10)})


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = crc_remainder(F.col("doc_id"), 7)
    scored = score(table(spark, sf_dir, "documents"), remainder != 2)
    return scored.withColumn("held_out", remainder == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
