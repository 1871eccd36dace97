"""Problem 8: evaluation passages that leak into a corpus.

Method: each shard of the corpus (a bounded piece of a partition) is turned into an FM-index over
word ids: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled suffix positions. The
phrases of the test items are searched backward through the wavelet ranks, all at once; the places
of the hits are found by walking to the next sampled suffix position; overlapping hits of an item
in a text are merged to spans. Words that no test item holds share one separator symbol, since no
phrase can cross them; that is exact, and keeps the index small.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_RUN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The text without case, accents, widths, zero-width characters and soft hyphens."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text))
    text = "".join([c for c in text if not unicodedata.combining(c)]).casefold()
    return unicodedata.normalize("NFKC", text)


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of a folded text."""
    return _RUN.findall(fold(text)) if text else []


class WaveletMatrix:
    """Ranks of symbols in an integer sequence, many at a time."""

    def __init__(self, seq: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.zeros, self.ranks = [], []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            r = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(1 - bit, out=r[1:])
            self.ranks.append(r)
            self.zeros.append(int(r[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.start = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (r, z) in enumerate(zip(self.ranks, self.zeros)):
            one = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            zero_rank = r[i]
            i = np.where(one, z + i - zero_rank, zero_rank)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol of ``c`` stands before the position of ``i``."""
        return self._down(c, i) - self.start[c]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the smallest and stand once."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(s[order][1:] != s[order][:-1])])
    k = 1
    while k < n and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        k *= 2
    return order


class FMIndex:
    """Backward search and location of phrases in a sequence of symbols 1 .. size - 1."""

    def __init__(self, seq: np.ndarray, size: int, every: int = 8):
        s = np.append(seq.astype(np.int64), 0)
        sa = suffix_array(s)
        self.n, self.every = len(s), every
        self.bwt = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])[:size]
        self.tree = WaveletMatrix(self.bwt, size)
        sampled = sa % every == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled, self.samples = sampled, sa[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with each row of ``phrases``."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the sequence of the given rows of the suffix array."""
        out = np.empty(len(rows), np.int64)
        live, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            hit = self.sampled[row]
            out[live[hit]] = self.samples[self.sampled_before[row[hit]]] + steps
            live, row = live[~hit], row[~hit]
            c = self.bwt[row]
            row = self.before[c] + self.tree.rank(c, row)
            steps += 1
        return out


def phrases_of(items: list[tuple[object, str | None]], least: int) -> tuple[dict[str, int], dict[int, tuple[np.ndarray, list[list[int]]]]]:
    """Word ids from 2 on, and by length the distinct phrases with the items that hold each."""
    ids: dict[str, int] = {}
    by: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for k, (_, passage) in enumerate(items):
        w = [ids.setdefault(x, len(ids) + 2) for x in words(passage)]
        n = min(least, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            own = by.setdefault(n, {}).setdefault(tuple(w[i : i + n]), [])
            if not own or own[-1] != k:
                own.append(k)
    return ids, {n: (np.array(list(p), np.int64), list(p.values())) for n, p in by.items()}


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, least: int = 13, shard_words: int = 2_000_000, block_chars: int = 20_000_000) -> DataFrame:
    """(key, item_key, spans, n_words): the items that stand in each text, and where.

    A text holds an item if it has ``least`` consecutive words of it, or all its words if it has
    fewer; ``spans`` are the merged hits as (first, last + 1) word numbers. Null and empty texts and
    passages hold nothing; repeated rows of a text have rows of their own; two items with the same
    passage are both reported; if both keys have one name, that of the items gets ``_item`` behind it. The items are broadcast in blocks of at most about
    ``block_chars`` characters, whose number comes from a count first; a shard is read and cut into
    words once, and searched for the phrases of one block after another. The corpus is neither
    shuffled nor collected.
    """
    items = items.select(F.col(item_key).alias("_item"), F.col(passage).alias("_passage")).where(F.length("_passage") > 0).distinct()
    if item_key == key:
        item_key = f"{item_key}_item"
    chars = items.agg(F.sum(F.length("_passage"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField(item_key, items.schema["_item"].dataType),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
            T.StructField("n_words", T.IntegerType()),
        ]
    )
    send = docs.sparkSession.sparkContext.broadcast
    shared = [send([tuple(r) for r in items.where(F.pmod(F.xxhash64("_passage"), F.lit(blocks)) == b).collect()]) for b in range(blocks)]
    return docs.select(key, text).mapInPandas(_search(shared, least, shard_words, key, item_key), schema)


def _search(shared, least, shard_words, key, item_key):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held_block: dict = {}

        def block(i):
            """(items, ids, phrases) of a block; only the last one used is kept."""
            if i not in held_block:
                held_block.clear()
                held_block[i] = (shared[i].value, *phrases_of(shared[i].value, least))
            return held_block[i]

        def hits(items, phrases, size, parts, owners, firsts, keys):
            """Indexes the runs of words that phrases can stand in, and gives the items found in each text."""
            seq = np.concatenate(parts)
            lengths = [len(p) for p in parts]
            owner = np.repeat(np.array(owners), lengths)
            place = np.concatenate([np.arange(f, f + n) for f, n in zip(firsts, lengths)])
            fm = FMIndex(seq, size)
            doc, item, first, end = [], [], [], []
            for n, (rows, own) in phrases.items():
                lo, hi = fm.search(rows)
                hit = np.nonzero(hi > lo)[0]
                if not len(hit):
                    continue
                counts = (hi - lo)[hit]
                at = np.repeat(hit, counts)
                row = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[hit], counts)
                where = fm.locate(row)
                many = np.array([len(own[h]) for h in hit])
                each = np.repeat(many, counts)
                doc.append(np.repeat(owner[where], each))
                item.append(np.concatenate([np.tile(own[h], c) for h, c in zip(hit, counts)]))
                first.append(np.repeat(place[where], each))
                end.append(first[-1] + n)
            if not doc:
                return None
            doc, item, first, end = (np.concatenate(x) for x in (doc, item, first, end))
            order = np.lexsort((first, item, doc))
            doc, item, first, end = doc[order], item[order], first[order], end[order]
            new_pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
            group = np.cumsum(new_pair) - 1
            rows = []
            for g0, g1 in zip(np.nonzero(new_pair)[0], [*np.nonzero(new_pair)[0][1:], len(group)]):
                spans = []
                for f, e in zip(first[g0:g1].tolist(), end[g0:g1].tolist()):
                    if spans and f <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([f, e])
                rows.append((keys[doc[g0]], items[item[g0]][0], [{"first": f, "end": e} for f, e in spans], sum(e - f for f, e in spans)))
            return pd.DataFrame(rows, columns=[key, item_key, "spans", "n_words"])

        sep = np.array([1])

        def flush(texts, vocabulary):
            """Searches a shard for the phrases of every block. ``texts`` are keys with the numbers of their words."""
            for i in range(len(shared)):
                items, ids, phrases = block(i)
                if not phrases:
                    continue
                shortest = min(phrases)
                of = np.fromiter((ids.get(w, 1) for w in vocabulary), np.int64, len(vocabulary))
                parts, owners, firsts, keys = [], [], [], []
                for k, numbers in texts:
                    if len(numbers) < shortest:
                        continue
                    arr = of[numbers]
                    edge = np.diff(np.concatenate([[0], (arr > 1).astype(np.int8), [0]]))
                    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
                    long = ends - starts >= shortest
                    for s, e in zip(starts[long], ends[long]):
                        parts += [arr[s:e], sep]
                        owners += [len(keys)] * 2
                        firsts += [s, 0]
                    if long.any():
                        keys.append(k)
                if parts and (x := hits(items, phrases, len(ids) + 2, parts, owners, firsts, keys)) is not None:
                    yield x

        texts, held = [], 0
        vocabulary: dict[str, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        for pdf in batches:
            for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                w = words(t)
                if not w:
                    continue
                texts.append((k, np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w))))
                held += len(w)
                if held >= shard_words:
                    yield from flush(texts, vocabulary)
                    texts, held = [], 0
                    vocabulary.clear()
        if texts:
            yield from flush(texts, vocabulary)

    return run
