"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Method: pair occurrence index. The distinct pre-tokens of a batch lie side by side in one symbol
array; an index maps every mergeable pair to all its positions; the active ranks are applied in
ascending order, each to all its positions at once, and only the lists of the neighbouring pairs
are updated. A word is merged once however often it occurs in the partition.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class PairIndexEncoder:
    """Encodes many words at once by the pair occurrence index; keeps what it has encoded.

    ``keep`` bounds the number of remembered words; beyond it the memory is emptied, which costs
    time but changes no result.
    """

    def __init__(self, ranks: dict[bytes, int], keep: int = 300_000):
        self.ranks, self.keep = ranks, keep
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.first = [ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _rank(self, a: int, b: int) -> int:
        r = self.pair_rank.get((a, b))
        if r is None:
            r = self.pair_rank[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def learn(self, words: Iterable[str]) -> None:
        """Adds the encodings of the words that are not known yet; afterwards all of ``words`` are known."""
        words = set(words)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = list(words)
        rank, first = self._rank, self.first
        sym: list[int] = []
        starts = []
        todo = []
        for w in new:
            data = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[w] = (whole,)
                continue
            starts.append(len(sym))
            todo.append(w)
            sym.extend([first[b] for b in data])
        n = len(sym)
        starts.append(n)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        for s, e in zip(starts, starts[1:]):
            prv[s] = -1
            nxt[e - 1] = -1
        where: dict[int, list[int]] = {}
        for s, e in zip(starts, starts[1:]):
            for p in range(s, e - 1):
                r = rank(sym[p], sym[p + 1])
                if r >= 0:
                    where.setdefault(r, []).append(p)
        active = list(where)
        heapify(active)
        again: list[int] = []
        while active:
            r = heappop(active)
            for p in sorted(where.pop(r)):
                q = nxt[p] if sym[p] >= 0 else -1
                if q < 0 or rank(sym[p], sym[q]) != r:
                    continue
                sym[p], sym[q] = r, -1
                nxt[p] = o = nxt[q]
                if o >= 0:
                    prv[o] = p
                for x in (prv[p], p):
                    y = nxt[x] if x >= 0 else -1
                    if y >= 0 and (t := rank(sym[x], sym[y])) >= 0:
                        if t < r:
                            again.append(p)
                        if t in where:
                            where[t].append(x)
                        elif t != r:
                            where[t] = [x]
                            heappush(active, t)
                        else:
                            again.append(p)
        for w, s in zip(todo, starts):
            out = []
            p = s
            while p >= 0:
                out.append(sym[p])
                p = nxt[p]
            self.known[w] = tuple(out)
        if again:  # a merge made a pair of no higher rank: those words are encoded one merge at a time
            from bisect import bisect_right

            for k in {bisect_right(starts, p) - 1 for p in again}:
                self.known[todo[k]] = self._one_by_one(todo[k])

    def _one_by_one(self, word: str) -> tuple[int, ...]:
        """The lowest rank first, the leftmost of equal ones, from a heap of pairs over a linked list."""
        s = [self.first[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(s)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := self._rank(s[i], s[i + 1])) >= 0]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = nxt[i]
            if s[i] != a or j >= n or s[j] != b:
                continue  # one of the two has merged since
            s[i], s[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (t := self._rank(s[x], s[y])) >= 0:
                    heappush(heap, (t, x, s[x], s[y]))
        return tuple(x for x in s if x >= 0)


def encode_texts(df: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str = PATTERN, batch_chars: int = 4_000_000, keep: int = 300_000) -> DataFrame:
    """(key, ids): the token ids of each whole text, without special tokens.

    Null and empty texts give an empty list; marker strings in a text are ordinary text; a repeated
    row gives a row each; other columns are not read; a key named ``ids`` comes out as ``ids_key``. The work is one pass without a shuffle; the
    vocabulary (a file of fixed size) is broadcast. ``batch_chars`` bounds the texts that are held
    at once in a task, except that one text always fits; ``keep`` bounds the words a task remembers
    from batch to batch.
    """
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(ranks)
    key_type = df.schema[key].dataType
    name = "ids_key" if key == "ids" else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        enc = PairIndexEncoder(shared.value, keep)
        split = regex.compile(pattern).findall

        def flush(keys, toks, kind):
            enc.learn(chain.from_iterable(toks))
            known = enc.known
            flat: list[int] = []
            ends = [0]
            for t in toks:
                flat.extend(chain.from_iterable([known[x] for x in t]))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.asarray(flat, np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), ids], names=[name, "ids"])

        for b in batches:
            keys, toks, chars = [], [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                keys.append(k)
                toks.append(split(t))
                chars += len(t)
                if chars >= batch_chars:
                    yield flush(keys, toks, b.column(0).type)
                    keys, toks, chars = [], [], 0
            if keys:
                yield flush(keys, toks, b.column(0).type)

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(name, key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


def ranks_of(name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> dict[bytes, int]:
    return load_ranks(os.path.join(tokenizer_dir, f"{name}.tiktoken"))
