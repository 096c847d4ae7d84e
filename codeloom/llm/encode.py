"""Encoding of a corpus with a public byte-level BPE vocabulary.

A task splits its texts into words by the vocabulary's pattern and encodes each
distinct word once. For these words it keeps a pair occurrence index: every
pair of neighbouring symbols that has a rank is mapped to all its positions.
Active ranks are applied in ascending order, each to all its positions from
left to right, and only the lists of the pairs around a merge change.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm.sources import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern by which this vocabulary splits text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_WORDS = 400_000  # words that a worker remembers; then it forgets them all


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.first = [self.ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self._forget()

    def rank(self, a: int, b: int) -> int:
        """The id that a pair merges to, or -1; it is the merge's rank as well."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return found

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by one pair occurrence index over all of them."""
        symbol: list[int] = []
        starts = []
        for w in words:
            starts.append(len(symbol))
            symbol.extend(self.first[x] for x in w)
            symbol.append(-1)  # words don't touch
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = symbol[i], symbol[i + 1]
            if a >= 0 and b >= 0:
                r = rank(a, b)
                if r >= 0:
                    where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            for i in sorted(where.pop(r, ())):
                a = symbol[i]
                if a < 0:
                    continue
                j = after[i]
                if j >= n or (b := symbol[j]) < 0 or rank(a, b) != r:
                    continue  # an earlier merge took one of the two
                symbol[i] = r
                symbol[j] = -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if symbol[k] >= 0 and (s := rank(r, symbol[k])) >= 0:
                        if s not in where:
                            where[s] = []
                            heapq.heappush(active, s)
                        where[s].append(i)
                h = before[i]
                if h >= 0 and symbol[h] >= 0 and (s := rank(symbol[h], r)) >= 0:
                    if s not in where:
                        where[s] = []
                        heapq.heappush(active, s)
                    where[s].append(h)
        out = []
        for start, w in zip(starts, words):
            out.append([s for s in symbol[start:start + len(w)] if s >= 0])
        return out

    def _forget(self) -> None:
        """The known words' ids, one after the other, and how many each has."""
        self.sizes, self.values = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if len(self.known) > MOST_WORDS:
            self.known = {}
            self._forget()
        known, fresh = self.known, []
        flat: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = self.split(text)
                counts[i] = len(words)
                for w in words:
                    at = known.get(w)
                    if at is None:
                        at = known[w] = len(known)
                        fresh.append(w)
                    flat.append(at)
        if fresh:  # only the new words are flattened
            new = self.merge([w.encode("utf-8") for w in fresh])
            self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, new), np.int64, len(new))))
            self.values = np.concatenate((self.values, np.fromiter((x for w in new for x in w), np.int32)))
        sizes, values = self.sizes, self.values
        begins = np.concatenate(([0], np.cumsum(sizes)))
        used = np.asarray(flat, np.int64)
        length = sizes[used]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) - np.repeat(ends - length, length) + np.repeat(begins[used], length)
        per_word = np.concatenate(([0], ends))
        cut = np.concatenate(([0], np.cumsum(counts)))
        return values[take], per_word[cut[1:]] - per_word[cut[:-1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_MOST_CHARS = 4_000_000  # of the texts that are encoded together


def _loads(texts: list) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _MOST_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids``, the token ids of each whole text without special tokens.

    Null and empty texts have no ids, an empty list. A special token's name in
    a text is ordinary text. Rows stay rows, repeated keys included.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _loads(texts):
                ids, counts = enc.encode(texts[begin:end])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), lists], names=[key, "ids"])

    return spread(documents.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the length of what `token_ids` would give, without moving the ids."""
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(last).to_pylist()
            for begin, end in _loads(texts):
                _, counts = enc.encode(texts[begin:end])
                kept = [batch.column(i).slice(begin, end - begin) for i in range(last)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return spread(documents.select(*keep, text), keep[0]).mapInArrow(run, f"{kinds}, n_tokens bigint")
