"""Problem 2: the same or nearly the same record in the training and the evaluation splits.

Method: similarity-hash bit fingerprints. What tells one name from another (its mark, or the whole
name where it has none and the caller asks for that) becomes three codes: a 64-bit parity hash of
its letter pairs, in which a changed letter flips at most four bits, so that two changes stay within
Hamming radius eight; and five bits a letter of its first and of its last twelve letters. (A
sign-of-sums hash of so short a text flips a quarter of its bits at two changes and cannot be
joined.) Codes are joined where a block of them agrees: the first five letters' bits, the last
three to five letters', or the four in the middle in one of three permutations that move them by up
to one place; two changes leave one of these whole. Joined pairs within the radius are verified by
the edit distance of marks and words. Names of equal content form one class on each side, and
records with the same names another, so copies are joined once and expanded last, or only counted.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, permutations
from os.path import commonprefix
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicketry.session import store

RADIUS, EDITS = 8, 2


@dataclass(frozen=True)
class NameForm:
    """How names are built: the ``letters`` and length of a mark, and a pattern for parts that are ``added`` and do not count.

    With ``whole``, a name without a mark of this form counts as one run of all its parts, in
    alphabetic order; without, it matches nothing.
    """

    letters: frozenset = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")
    least: int = 12
    most: int = 16
    added: str = r"^$"
    whole: bool = False


def plain(name: str) -> str:
    """The name without accents, widths and percent signs; case is kept."""
    if "%" in name:
        name = unquote(name)
    if not name.isascii():
        name = unicodedata.normalize("NFKD", name)
        name = "".join([c for c in name if not unicodedata.combining(c)])
    return name


_TOKEN = re.compile(r"[^\W_]+")
_UPPER = "[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isupper() and c.isalnum()) + "]"
_CAMEL = re.compile(rf"{_UPPER}{{2,}}(?!(?!{_UPPER})[^\W_])|{_UPPER}(?:(?!{_UPPER})[^\W_])*|(?:(?!{_UPPER})[^\W_])+")


def parse(name: str, form: NameForm) -> tuple[tuple[str, str], ...]:
    """(mark, words) of a name of any length: one for a clean name, several candidate marks for a glued one, none for one without.

    ``words`` are sorted and joined by blanks; of a glued name it is the whole run, after ``=``. Of
    several parts that could be the mark each is a candidate; ``+`` stands before the words of all
    but the likeliest, which has letters and the fewest of others. One letter over and over holds no words beside a mark, and is none.
    """
    return _short(name, form) if len(name) <= 400 else _parse(name, form)


def _parse(name: str, form: NameForm) -> tuple[tuple[str, str], ...]:
    added = re.compile(form.added).match
    tokens = _TOKEN.findall(plain(name))
    low = [t.casefold() for t in tokens]
    split, glued = low, any(len(t) > form.most for t in low)
    if not all(t.islower() or t.isupper() for t in tokens):
        split = [p.casefold() for t in tokens for p in ([t] if t.islower() or t.isupper() else _CAMEL.findall(t))]
    ranked = []
    for parts in (low,) if split == low else (low, split):
        for i, t in enumerate(parts):
            if form.least <= len(t) <= form.most and (foreign := sum(c not in form.letters for c in t)) <= EDITS:
                ranked.append((t.isdigit(), foreign, parts is not low, i))
    found: dict[str, str] = {}
    for _, _, cut, i in sorted(ranked):
        parts = split if cut else low
        if parts[i] not in found:
            words = " ".join(sorted(t for j, t in enumerate(parts) if j != i and not added(t)))
            found[parts[i]] = "+ " + words if found else words
    clean = tuple(found.items())
    if clean and not (glued and any(len(t) > form.most for t in split)):
        return clean
    rest = [t for t in low if not added(t)]
    run = "".join(rest)
    # a mark and at least a letter of each of three words
    if len(run) >= form.least + 3 and len(set(run)) > 1:
        foreign = [0]
        for c in run:
            foreign.append(foreign[-1] + (c not in form.letters))
        out = {run[i : i + n]: None for n in range(form.least, form.most + 1) for i in range(len(run) - n + 1) if foreign[i + n] - foreign[i] <= EDITS}
        if out:
            words = "=" + run
            # digits alone are less likely a mark than a part of the run
            clean = tuple((m, "+ " + w if m.isdigit() and w[:1] != "+" else w) for m, w in clean)
            return clean + tuple((m, words) for m in out)
    if clean:
        return clean
    run = "".join(sorted(rest))
    return ((run, ""),) if form.whole and run else ()


_short = lru_cache(maxsize=200_000)(_parse)


def places(mark: str) -> tuple[int, int]:
    """Five bits a letter, of the first twelve letters from the top and of the last twelve to the bottom."""
    first = last = 0
    for c in mark[:12].ljust(12, "\0"):
        first = first << 5 | (ord(c) * 7 & 31)
    for c in mark[-12:]:
        last = last << 5 | (ord(c) * 7 & 31)
    return first, last


_BIT: dict[str, int] = {}


def fingerprint(mark: str) -> int:
    """64 bits, each the parity of the letter pairs that hash to it, as a signed number."""
    x, m = 0, "^" + mark + "$"
    for i in range(len(m) - 1):
        p = m[i : i + 2]
        b = _BIT.get(p)
        if b is None:
            b = _BIT[p] = 1 << ((ord(p[0]) * 0x9E3779B1 + ord(p[1]) * 0x85EBCA77 >> 7) % 64)
        x ^= b
    return x - (1 << 64) if x >> 63 else x


def edits(a: str, b: str, inside: bool = False) -> int:
    """Edit distance; with ``inside``, to the most similar substring of ``b``."""
    if a == b or inside and a in b:
        return 0
    row = [0] * (len(b) + 1) if inside else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row) if inside else row[-1]


def _few(a: str, b: str, inside: bool = False) -> int:
    """``edits`` as far as ``EDITS``, beyond that some larger number; in time that grows with the lengths, not with their product."""
    if a == b or inside and a in b:
        return 0
    if not inside:
        return _band(a, b, 0, False) if abs(len(a) - len(b)) <= EDITS else EDITS + 1
    if len(a) <= EDITS or len(b) <= 64:
        return edits(a, b, True)
    # of three pieces of ``a`` two edits leave one whole, which says where the rest must stand
    n, best, tried = EDITS + 1, EDITS + 1, set()
    for k in range(n):
        s, e = k * len(a) // n, (k + 1) * len(a) // n
        at = b.find(a[s:e])
        while at >= 0:
            if at - s not in tried:
                tried.add(at - s)
                best = min(best, _band(a, b, at - s, True))
            at = b.find(a[s:e], at + 1)
    return best


def _band(a: str, b: str, mid: int, free: bool) -> int:
    """Edits that keep every letter of ``a`` within ``EDITS`` places of ``mid`` places further on in ``b``; ``free``: ends of ``b`` do not count."""
    far, size = EDITS + 1, len(b)
    shifts = range(mid - EDITS, mid + EDITS + 1)
    row = [far if not 0 <= d <= size else 0 if free else d for d in shifts]
    for i, x in enumerate(a):
        left, new = far, []
        for k, d in enumerate(shifts):
            j = i + d
            if 0 <= j + 1 <= size:
                left += 1
                if j >= 0 and row[k] + (b[j] != x) < left:
                    left = row[k] + (b[j] != x)
                if k < 2 * EDITS and row[k + 1] + 1 < left:
                    left = row[k + 1] + 1
            else:
                left = far
            new.append(left)
        row = new
        if min(row) > EDITS:
            return far
    if free:
        return min(row)
    return row[size - len(a) - mid + EDITS]


def _within(parts: list[str], run: str) -> int:
    """Edits that make all ``parts`` stand in ``run``, in any order, apart from one another."""
    missing = []
    for p in sorted(parts, key=len, reverse=True):
        if p in run:
            run = run.replace(p, "|", 1)
        else:
            missing.append(p)
    if len(missing) > EDITS:
        return 99
    rest = [x for x in run.split("|") if x]
    if not missing:
        return 0
    if not rest:
        return sum(map(len, missing))
    if len(missing) == 1:
        return min(_few(missing[0], r, True) for r in rest)
    best = min(_few(a + b, r, True) for r in rest for a, b in permutations(missing))
    if len(rest) > 1:
        best = min(best, *(_few(missing[0], r, True) + _few(missing[1], s, True) for i, r in enumerate(rest) for j, s in enumerate(rest) if i != j))
    return best


def name_distance(mark_a: str, words_a: str, mark_b: str, words_b: str) -> int:
    """Edits between two parsed names over mark and words; what was added does not count."""
    for w, mark, other in ((words_a, mark_a, words_b), (words_b, mark_b, words_a)):
        if w[:1] == "+" and (other[:1] == "+" or other[:1] == "=" and mark.isdigit()):  # neither is the likeliest mark of its name
            return 99
    words_a, words_b = words_a.removeprefix("+ "), words_b.removeprefix("+ ")
    glued_a, glued_b = words_a[:1] == "=", words_b[:1] == "="
    if glued_a and glued_b:
        return min(_few(words_a, words_b), _glued(mark_a, words_a[1:], mark_b, words_b[1:]))
    if glued_b:
        return _some(words_a.split(), [mark_a], words_b[1:], EDITS)
    if glued_a:
        return _some(words_b.split(), [mark_b], words_a[1:], EDITS)
    if min(len(mark_a), len(mark_b)) < 12:
        return 0 if mark_a == mark_b else 99
    d = _few(mark_a, mark_b)
    if words_a == words_b:
        return d
    a, b = Counter(words_a.split()), Counter(words_b.split())
    same = (a & b).total()
    if same >= 3:
        return d
    left_a, left_b = list((a - b).elements()), list((b - a).elements())
    if len(left_a) > len(left_b):
        left_a, left_b = left_b, left_a
    if d > EDITS:
        return d
    # no part left over equals another, so each that is matched costs an edit
    need, cost = 3 - same, [(c, i, j) for i, x in enumerate(left_a) for j, y in enumerate(left_b) if abs(len(x) - len(y)) <= EDITS and (c := _few(x, y)) <= EDITS - d]
    if need == 1 and cost:
        return d + min(cost)[0]
    if need == 2 and any(c == e == 1 and i != k and j != m for (c, i, j), (e, k, m) in combinations(cost, 2)):
        return d + 2
    # parts of one may be glued in the other
    more, fewer = sorted((words_a.split(), words_b.split()), key=len, reverse=True)
    best = _some(more, [], "".join(fewer), EDITS - d)
    if best > EDITS - d and len(fewer) >= 3:
        best = _some(fewer, [], "".join(more), EDITS - d)
    return d + best


def _some(words: list[str], marks: list[str], run: str, most: int) -> int:
    """Edits that make three of the ``words`` (all, if there are fewer) and the ``marks`` stand in ``run``: the first number found up to ``most``."""
    if len(words) <= 3:
        return _within([*words, *marks], run)
    if any(_few(m, run, True) > most for m in marks):
        return 99
    ranked = sorted((c, -len(w), w) for w in words if (c := _few(w, run, True)) <= most)
    return next((c for three in combinations(ranked, 3) if (c := _within([*(w for _, _, w in three), *marks], run)) <= most), 99)


def _glued(mark_a: str, run_a: str, mark_b: str, run_b: str) -> int:
    """Edits between two glued names cut at their marks: of the marks, and of what is left, in any order of three words and apart from what is glued on to one of them."""
    d = _few(mark_a, mark_b)
    if d > EDITS:
        return 99
    left = []
    for mark, run in ((mark_a, run_a), (mark_b, run_b)):
        i = run.index(mark)
        left.append((run[:i], run[i + len(mark) :]))
    (a, b), (c, e) = left
    best = min(_few(*sorted((x, y), key=len), True) for x in {a + b, b + a} for y in {c + e, e + c})
    # both may have something glued on: what is the same next to the marks, of three words at least nine letters
    if len(commonprefix((b, e))) + len(commonprefix((a[::-1], c[::-1]))) >= 9:
        best = 0
    if d + best > EDITS:
        # where the words are cut is not known: every way to cut the shorter one, whose mark may stand between them
        (x, y), other = sorted(left, key=lambda p: len(p[0]) + len(p[1]))
        if len(x) + len(y) <= 64:
            n = 1 if x and y else 2
            cut = lambda t, at: [t[s:e] for s, e in zip((0, *at), (*at, len(t))) if s < e]
            ways = (cut(x, i) + cut(y, j) for k in range(n + 1) for i in combinations(range(1, len(x)), k) for j in combinations(range(1, len(y)), n - k))
            best = next((c for w in ways if d + (c := _within(w, "|".join(other))) <= EDITS), best)
    return d + best


def _bits(code: Column, shift: int, letters: int) -> Column:
    """The bits of some letters of a code, ``shift`` letters from its end."""
    return F.shiftright(code, 5 * shift).bitwiseAND(F.lit((1 << 5 * letters) - 1).cast("bigint"))


def _blocks(probe: bool) -> Column:
    """The code blocks under which a mark is filed, as structs (block, kind, moved), from the columns front, back and length.

    The bits of the first five letters, of the sixth to ninth, and of the last five, four or three
    of those that are left. A mark is looked up by its first, by its middle moved by up to one place,
    and by its last three to five. Of three blocks apart two edits leave one whole; the middle is
    needed only where one edit is before and one behind it, so that it has moved by one place at most.
    """
    front, back, n = F.col("front"), F.col("back"), F.col("length")

    def seg(kind: int, bits: Column, moved: int = 0) -> Column:
        return F.struct((bits + F.lit(kind << 40)).alias("block"), F.lit(kind).alias("kind"), F.lit(moved).alias("moved"))

    tail = lambda k: seg(k, _bits(back, 0, k))
    if not probe:
        return F.array(seg(0, _bits(front, 7, 5)), seg(1, _bits(front, 3, 4)), F.when(n >= 14, tail(5)).when(n == 13, tail(4)).otherwise(tail(3)))
    return F.array(seg(0, _bits(front, 7, 5)), *(seg(1, _bits(front, 3 - k, 4), k) for k in (-1, 0, 1)), *map(tail, (3, 4, 5)))


def _parts(probe: bool) -> Column:
    """The finer keys of a crowded block, by the same rule on what the block leaves open.

    First or last letters whole: nine others in three threes, the middle one moved by up to one
    place. Middle whole: one edit is in the first five, of which two or the last three are whole.
    """
    front, back, n, block, kind, moved = (F.col(c) for c in ("front", "back", "length", "block", "kind", "moved"))
    key = lambda tag, bits: F.xxhash64(block, F.lit(tag), bits)
    moves = (-1, 0, 1) if probe else (0,)
    last = [key(f"z{w}", _bits(back, 0, w)) for w in (1, 2, 3)]
    ends = F.array(*last) if probe else F.array(F.when(n >= 14, last[2]).when(n == 13, last[1]).otherwise(last[0]))
    head = F.concat(F.array(key("a", _bits(front, 4, 3)), *(key("b", _bits(front, 1 - m, 3)) for m in moves)), ends)
    near = F.when(moved == -1, _bits(front, 8, 3)).when(moved == 1, _bits(front, 6, 3)).otherwise(_bits(front, 7, 3))
    middle = F.array(key("p", _bits(front, 10, 2)), key("q", near))
    before = F.when(kind == 3, _bits(back, 3, 3)).when(kind == 4, _bits(back, 4, 3)).otherwise(_bits(back, 5, 3))
    tail = F.array(key("a", _bits(front, 9, 3)), *(key("b", _bits(front, 6 - m, 3)) for m in moves), key("c", before))
    return F.array_distinct(F.when(kind == 0, head).when(kind == 1, middle).otherwise(tail))


def overlap_links(rows: DataFrame, form: NameForm, crowd: int = 2_000, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(members, links): (item, evaluation, record) of the rows with a name, and (record_train, record_eval) of those that show the same.

    ``rows`` has (item, evaluation BOOLEAN, name): one row per name of an item, of which it may have
    several. Items of a side with the same names are one ``record``. Nulls are left out; a name
    without a mark matches nothing, unless the form says ``whole``; a link comes out once; an empty
    side gives none. A block shared by more than ``crowd`` different training names is split by
    finer keys, which lose no pair either.
    """
    item_type = rows.schema["item"].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, found, long = [], [], {}
            for i, name in enumerate(b.column(2).to_pylist()):
                for m, w in parse(name, form):
                    if len(w) > 256 and w[0] == "=":
                        # a long run stands once, in a row without a mark, for all its windows
                        if w not in long:
                            long[w] = "=#" + hashlib.sha256(w.encode("utf-8", "surrogatepass")).hexdigest()
                            at.append(i)
                            found.append((None, long[w], w))
                        w = long[w]
                    at.append(i)
                    found.append((m, w, None))
            cols = list(zip(*found)) or [[]] * 3
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, pa.string()) for c in cols)], names=shape.names)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            marks = b.column(2).to_pylist()
            cols = list(zip(*((fingerprint(m), *places(m), len(m)) for m in marks))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32())))], names=coded.names)

    shape = T.StructType([T.StructField("item", item_type), T.StructField("evaluation", T.BooleanType())]).add("mark", "string").add("words", "string").add("run", "string")
    coded = T.StructType().add("evaluation", "boolean").add("id", "long").add("mark", "string").add("words", "string").add("code", "long").add("front", "long").add("back", "long").add("length", "integer")
    rows = rows.where(F.col("item").isNotNull() & F.col("evaluation").isNotNull() & F.col("name").isNotNull())
    named = rows.select("item", "evaluation", "name").mapInArrow(run, shape)
    named = store(named.withColumn("id", F.xxhash64("mark", "words")))
    runs = named.where("mark is null").groupBy("words").agg(F.min("run").alias("run"))
    named = named.where("mark is not null").drop("run")
    codes = ["code", "front", "back", "length"]
    classes = named.groupBy("evaluation", "id").agg(F.min(F.struct("mark", "words")).alias("c"))
    classes = store(classes.select("evaluation", "id", "c.*").mapInArrow(encode, coded))
    part = lambda e: classes.where("evaluation" if e else "not evaluation")
    filed = lambda e: part(e).select("id", *codes, F.explode(_blocks(e)).alias("s")).select("id", *codes, "s.*")
    within = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= radius

    def meet(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
        a = a.select(on, F.col("id").alias("id_a"), F.col("code").alias("code_a"))
        b = b.select(on, F.col("id").alias("id_b"), F.col("code").alias("code_b"))
        return a.join(b, on).where(within).select("id_a", "id_b")

    # blocks that hold very many classes on a side are joined by finer keys instead
    size = filed(False).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    hot = store(size.where(F.col("n") > crowd).select("block"))
    if hot.isEmpty():
        near = meet(filed(False), filed(True), "block")
    else:
        rare = lambda e: filed(e).join(hot, "block", "left_anti")
        fine = lambda e: filed(e).join(hot, "block", "left_semi").select("id", "code", F.explode(_parts(e)).alias("key"))
        near = meet(rare(False), rare(True), "block").unionByName(meet(fine(False), fine(True), "key"))
    near = near.distinct()
    text = lambda e, x: part(e).select(F.col("id").alias(f"id_{x}"), F.col("mark").alias(f"mark_{x}"), F.col("words").alias(f"words_{x}"))
    near = near.join(text(False, "a"), "id_a").join(text(True, "b"), "id_b")
    near = near.where((F.levenshtein("mark_a", "mark_b", EDITS) >= 0) | F.col("words_a").startswith("=") | F.col("words_b").startswith("="))

    if not runs.isEmpty():
        runs = store(runs)
        for x in ("a", "b"):
            near = near.join(runs.select(F.col("words").alias(f"words_{x}"), F.col("run").alias(f"run_{x}")), f"words_{x}", "left")
            near = near.withColumn(f"words_{x}", F.coalesce(f"run_{x}", f"words_{x}")).drop(f"run_{x}")

    @F.pandas_udf("int")
    def distance(ma, wa, mb, wb):
        import pandas as pd

        return pd.Series([None if x[0] is None else name_distance(*x) for x in zip(ma, wa, mb, wb)], dtype="Int32")

    same = (F.col("mark_a") == F.col("mark_b")) & (F.col("words_a") == F.col("words_b"))
    near = near.where(same | (distance(F.when(~same, F.col("mark_a")), "words_a", "mark_b", "words_b") <= EDITS)).select("id_a", "id_b")
    # items with the same names are one record
    members = named.groupBy("evaluation", "item").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    members = store(members.select("evaluation", "item", F.xxhash64("ids").alias("record"), "ids"))
    holds = members.groupBy("evaluation", "record").agg(F.min("ids").alias("ids")).select("evaluation", "record", F.explode("ids").alias("id"))
    side = lambda e, x, y: holds.where("evaluation" if e else "not evaluation").select(F.col("id").alias(f"id_{x}"), F.col("record").alias(f"record_{y}"))
    links = near.join(side(False, "a", "train"), "id_a").join(side(True, "b", "eval"), "id_b").select("record_train", "record_eval").distinct()
    return members.drop("ids"), store(links)


def cross_split_overlaps(rows: DataFrame, form: NameForm, crowd: int = 2_000) -> DataFrame:
    """(item_train, item_eval): the pairs of items that show the same record, each once; see ``overlap_links``."""
    members, links = overlap_links(rows, form, crowd)
    left = members.where("not evaluation").select(F.col("item").alias("item_train"), F.col("record").alias("record_train"))
    right = members.where("evaluation").select(F.col("item").alias("item_eval"), F.col("record").alias("record_eval"))
    return links.join(left, "record_train").join(right, "record_eval").select("item_train", "item_eval")


def overlap_counts(rows: DataFrame, form: NameForm, groups: DataFrame, columns: list[str], crowd: int = 2_000) -> DataFrame:
    """The number of overlapping pairs by the ``columns`` of the training and of the evaluation row, as train_*, eval_* and ``pairs``.

    ``groups`` has one row an item with these columns. Records are counted by group and the numbers
    multiplied over the links, so no pair of copies is made.
    """
    members, links = overlap_links(rows, form, crowd)

    def counted(e: bool, side: str) -> DataFrame:
        own = members.where("evaluation" if e else "not evaluation").join(groups.select("item", *columns), "item")
        own = own.groupBy("record", *columns).agg(F.count(F.lit(1)).alias(f"n_{side}"))
        return own.select(F.col("record").alias(f"record_{side}"), *(F.col(c).alias(f"{side}_{c}") for c in columns), f"n_{side}")

    out = links.join(counted(False, "train"), "record_train").join(counted(True, "eval"), "record_eval")
    return out.groupBy(*(f"{s}_{c}" for s in ("train", "eval") for c in columns)).agg(F.sum(F.col("n_train") * F.col("n_eval")).alias("pairs"))
