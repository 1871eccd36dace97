"""Problem 9: per-document text quality statistics.

Method: three signals of every run of lines that stand directly below one another, each between 0
and 1: how far delimiters stand below one another (vertical alignment, by number and by column), how
far line beginnings, that is leading blanks, markers and field names, come again with a short period
(indentation periodicity), and how far line lengths repeat (autocorrelation). Their weighted sum,
less the share of lines that read like prose, says which lines are tables or lists. What is left is
joined and cut into sentences, which are told from keywords, machine output and garbled characters
by word, symbol and punctuation ratios and the share of common words. All figures of a batch are
made at once, by Arrow's string kernels and array arithmetic over all its lines and sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

# Common function words of four languages, and common characters of Chinese prose.
COMMON_WORDS = frozenset(
    """a and are as at be but by for from had has have if in into is it no not of on or so than that the then this to was we were
    what when which who will with you
    aber als am auf aus bei das dem den der des die ein eine einem einen einer es für hat im ist mit nach nicht sich sie so sind
    über um und von wenn wie wir zu zum zur
    au avec ce cette dans de des du elle en est et il ils la le les mais ne on ou par pas plus pour que qui sur un une
    al como con cuando del el ella las lo los más no para pero por que se si sin su una y""".split()
)
COMMON_CJK = frozenset("的了在是和就不有也着没都还这那从到过把被让与但因为如果之")

#: Weights of alignment, periodicity, autocorrelation and short lines; of lines read as prose; the score from which lines are structured.
WEIGHTS, FLUENT, STRUCTURED = (0.5, 0.5, 0.5, 0.12), 1.0, 0.15
SHORT = 40  # characters a line, on average, over three lines or more that hold no sentence

# Patterns for Arrow's kernels (no look-around), and for cutting.
_MARK = r"^\s*(?:[-*•·‣▪◦–—+]\s|\(?\d{1,4}[.)]\s|\(?[A-Za-z][.)]\s|\(?[ivx]{1,5}[.)]\s|\[[ xX✓]?\]|\[[\d:. -]+\]|[☐☑✓✗])"
_FIELD = r"^\s*[\"']?[\p{L}\p{N}_./-]+(?: [\p{L}\p{N}_./-]+){0,2}[\"']?\s*(?:[:=]\s*\S|=>|->)"
_END = r"[.!?…。！？؟।][\"'”’»«)\]）】」』]*\s*$"
_TAG = r"<[a-zA-Z/][^<>]{0,80}>"
_GAP = r"[^\s](?: {2,}|\t+)[^\s]"
# What prose may hold beside letters, numbers and blanks, and letters that wrong decoding leaves.
_USUAL, _BROKEN = frozenset(".,;:!?'\"’‘“”«»()-–—…。，、；：？！（）《》「」『』·%¿¡"), frozenset("ÃÂı\ufffd")
_STYLE = re.compile(r"\*\*?|__|(?<!\w)_|_(?!\w)|`")  # marks of bold and slanted words
_BLOCK = re.compile(r"(?i)(?=<(?:table|ul|ol|pre))|(?<=</table>)|(?<=</pre>)|(?<=</ul>)|(?<=</ol>)")
_QUOTED = re.compile(r"^[“\"]?(?:\s*>)+ ?")  # the marks of quoted lines are not part of the prose
_CUT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])")


BLANK, LETTER, DIGIT, NUMBER, ODD, EAST, EAST_COMMON, COMMA, EAST_COMMA = (1 << i for i in range(9))
_EAST = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The classes of each character up to U+FFFF as bits, combining marks being letters; of those beyond, letters count as letters, the rest as odd."""
    table = np.zeros(0x10000, np.uint16)
    for i in range(0x10000):
        c = chr(i)
        kind = unicodedata.category(c)
        bits = BLANK * (kind[0] == "Z" or c.isspace()) | LETTER * (kind[0] in "LM") | DIGIT * (kind == "Nd") | NUMBER * (kind[0] == "N")
        if c in _BROKEN or not (bits or c in _USUAL):
            bits |= ODD
        table[i] = bits | EAST * bool(_EAST.match(c)) | EAST_COMMON * (c in COMMON_CJK) | COMMA * (c in ",;|•>/") | EAST_COMMA * (c in ",、")
    return table


class _Strings:
    """Counts over many strings at once, as arrays."""

    def __init__(self, strings: list[str]):
        import pyarrow as pa
        import pyarrow.compute as pc

        self.pc, self.a, self.n = pc, pa.array(strings, pa.large_string()), len(strings)
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bits = _classes()[np.minimum(codes, 0xFFFF)]
        for i in np.nonzero(codes > 0xFFFF)[0]:
            self.bits[i] = LETTER | EAST * (0x20000 <= codes[i] < 0x30000) if chr(codes[i]).isalpha() else ODD
        self.length = np.fromiter(map(len, strings), np.int64, self.n)
        self.end = np.cumsum(self.length)

    def of(self, kind: int) -> np.ndarray:
        """How many characters of a class each string has."""
        narrow = np.int32 if len(self.bits) < 1 << 31 else np.int64
        total = np.concatenate([np.zeros(1, narrow), np.cumsum((self.bits & kind) != 0, dtype=narrow)])
        return total[self.end] - total[self.end - self.length]

    def count(self, pattern: str) -> np.ndarray:
        return self.pc.count_substring_regex(self.a, pattern).to_numpy()

    def match(self, pattern: str) -> np.ndarray:
        return self.pc.match_substring_regex(self.a, pattern).to_numpy(zero_copy_only=False)

    def find(self, pattern: str) -> np.ndarray:
        return self.pc.find_substring_regex(self.a, pattern).to_numpy()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, common words and words in small letters of each string."""
        import pyarrow as pa

        pc = self.pc
        parts = pc.split_pattern_regex(self.a, r"[^\p{L}\p{M}'’]+")
        owner = np.repeat(np.arange(self.n), pc.list_value_length(parts).to_numpy())
        flat = pc.utf8_trim(parts.flatten(), "'’")
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(flat)
        small = pc.equal(flat, low).to_numpy(zero_copy_only=False)  # also of letters without case
        common = pc.is_in(low, value_set=pa.array(sorted(COMMON_WORDS), pa.large_string())).to_numpy(zero_copy_only=False)
        return tuple(np.bincount(owner[m], minlength=self.n) for m in (real, real & common, real & small))


def _shares(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Mean of the values of each group, for each member."""
    n = np.bincount(group, minlength=groups)
    return (np.bincount(group, value, groups) / np.maximum(1, n))[group]


def _before(group: np.ndarray, lag: int) -> np.ndarray:
    """The places that have another ``lag`` places before them in the same group."""
    i = np.arange(lag, len(group))
    return i[group[i] == group[i - lag]]


def _alignment(s: _Strings, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each line's delimiters stand below or above those of a neighbour, and which alignment segment it is in.

    As many of a delimiter as in the neighbouring line give 0.6, and the first of them in the same
    column (one off at most) the rest; of commas and semicolons two must be alike.
    """
    best, segment = np.zeros(s.n), np.full(s.n, -1, np.int64)
    for k, (mark, least) in enumerate(((r"\|", 1), (r"\t", 1), (",", 2), (";", 2), (_GAP, 1))):
        n = s.count(mark)
        if not (n >= least).any():
            continue
        at = s.find(mark)
        i = _before(run, 1)
        i = i[(n[i] == n[i - 1]) & (n[i] >= least)]
        value = np.where(np.abs(at[i] - at[i - 1]) <= 1, 1.0, 0.6)
        own = np.zeros(s.n)
        np.maximum.at(own, i, value)
        np.maximum.at(own, i - 1, value)
        joined = np.zeros(s.n, bool)
        joined[i] = True
        name = np.cumsum(~joined) * 8 + k
        better = own > best
        best[better], segment[better] = own[better], name[better]
    return best, segment


def _periodicity(code: np.ndarray, run: np.ndarray, runs: int, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The share of the lines of each run that begin like the line one period before, and the period; code 0 is no beginning."""
    n = np.bincount(run, minlength=runs)
    best, period = np.zeros(runs), np.zeros(runs, np.int64)
    for p in range(1, most + 1):
        i = _before(run, p)
        if not len(i):
            break
        i = i[(code[i] == code[i - p]) & (code[i] != 0)]
        share = np.where(n >= 2 * p, np.bincount(run[i], minlength=runs) / np.maximum(1, n - p), 0)
        better = share > best + 0.05
        best[better], period[better] = share[better], p
    return best, period


def _autocorrelation(length: np.ndarray, group: np.ndarray, groups: int, most: int = 6) -> np.ndarray:
    """The largest autocorrelation of the line lengths of each group at the lags 1 to ``most``; 1 where all are equal, 0 under four lines."""
    n = np.bincount(group, minlength=groups)
    mean = np.bincount(group, length, groups) / np.maximum(1, n)
    dev = length - mean[group]
    var = np.bincount(group, dev * dev, groups)
    best = np.zeros(groups)
    for lag in range(1, most + 1):
        i = _before(group, lag)
        cov = np.bincount(group[i], dev[i] * dev[i - lag], groups)
        ok = n >= 2 * lag
        best = np.where(ok, np.maximum(best, cov / np.maximum(var, 1e-9) * n / np.maximum(1, n - lag)), best)
    even = var <= n * (0.03 * mean + 0.5) ** 2
    return np.where(n < 4, 0.0, np.where(even, 1.0, np.minimum(1.0, best)))


def _prose(pieces: list[str]) -> np.ndarray:
    """Which pieces of text read as sentences of running prose."""
    s = _Strings([_STYLE.sub("", x) if "*" in x or "_" in x or "`" in x else x for x in pieces])
    n, plain, digits, odd, east_letters = s.length - s.of(BLANK), s.of(LETTER), s.of(DIGIT), s.of(ODD), s.of(EAST)
    ended = s.match(_END)
    w, common, lower = s.words()
    sane = (n >= 8) & (odd <= 0.1 * n) & (plain >= 0.5 * n) & (digits <= 0.35 * n)
    east = (east_letters >= 0.3 * plain) & (east_letters >= 5)
    fluent_east = ended & (s.of(EAST_COMMA) < 0.12 * n) | (east_letters >= 25) & (s.of(EAST_COMMON) >= 0.04 * east_letters)
    commas = s.of(COMMA)
    by_words = (common >= 0.16 * w) & (commas <= 0.3 * w)
    # a sentence of any language: ended, in small letters, of words of usual length, with few commas
    by_shape = (common < 0.16 * w) & ended & (commas <= 0.15 * w) & (lower >= 0.5 * w) & ((common >= 0.05 * w) | (w >= 6)) & (plain >= 0.7 * n) & (plain >= 2.2 * w) & (plain <= 12 * w)
    return sane & np.where(east, fluent_east, (w >= 4) & (by_words | by_shape))


def measure(texts: list[str], weights: tuple[float, ...] = WEIGHTS) -> dict[str, np.ndarray]:
    """The figures of whole texts, none of them blank."""
    lines: list[str] = []
    doc, gap = [], []
    for d, text in enumerate(texts):
        if "<" in text:
            text = _BLOCK.sub("\n", text)
        last = True
        for x in text.splitlines():
            if ">" in x:
                x = _QUOTED.sub("", x)
            if not x or x.isspace():
                last = True
                continue
            lines.append(x)
            doc.append(d)
            gap.append(last)
            last = False
        if not doc or doc[-1] != d:  # nothing but marks of quotation
            lines.append(" ".join(text.split()))
            doc.append(d)
            gap.append(True)
    docs, doc, gap = len(texts), np.array(doc, np.int64), np.array(gap, bool)
    gap[np.concatenate([[True], doc[1:] != doc[:-1]])] = True
    run = np.cumsum(gap) - 1
    runs = int(run[-1]) + 1
    s = _Strings(lines)
    length, size = s.length, s.length - s.of(BLANK)
    words, common, _ = s.words()
    ended, cjk, east = s.match(_END), s.of(EAST), s.of(EAST_COMMON)
    fluent = np.where(cjk >= 12, ended | (east >= 0.05 * cjk) & (cjk >= 25), (common >= 0.16 * np.maximum(1, words)) & (words >= 3) | ended & (words >= 6))
    # the three signals
    aligned, segment = _alignment(s, run)
    marked, field = s.match(_MARK), s.match(_FIELD)
    field &= ~marked & ~fluent
    blanks = length - s.pc.utf8_length(s.pc.utf8_ltrim_whitespace(s.a)).to_numpy()
    heads = np.zeros(s.n, np.int64)
    for i in np.nonzero(field)[0]:
        heads[i] = hash(lines[i].split(":")[0].strip()[:20]) >> 8 | 1
    code = np.where(marked, 1 + 8 * np.minimum(blanks, 99), np.where(field, heads, np.where(blanks > 0, 2 + 8 * np.minimum(blanks, 99), 0)))
    recurring, period = _periodicity(code, run, runs)
    dull = ~fluent & (common <= 0.1 * words) & ~ended
    stretch = np.cumsum(gap | np.concatenate([[True], dull[1:] != dull[:-1]])) - 1
    stretches = int(stretch[-1]) + 1
    in_stretch = np.bincount(stretch)
    repeating = np.where(dull, _autocorrelation(length.astype(float), stretch, stretches)[stretch], 0.0)
    short = dull & (in_stretch[stretch] >= 3) & (_shares(stretch, length, stretches) <= SHORT)
    # the score of a line: of its alignment segment, its run, and its stretch of lines that are no prose
    whole = np.where(segment >= 0, segment, -1)
    _, whole = np.unique(whole, return_inverse=True)
    smooth = np.where(segment >= 0, _shares(whole, fluent, int(whole.max()) + 1), fluent)
    begins = np.where((marked | field | (blanks > 0)), recurring[run], 0.0)
    score = weights[0] * aligned + weights[1] * begins + weights[2] * repeating + weights[3] * short - FLUENT * np.maximum(0, smooth - 0.34)
    table = (aligned > 0) & (score >= STRUCTURED) & (smooth <= 0.34)
    tags = s.count(_TAG)
    table |= (tags >= 3) & (s.pc.binary_length(s.pc.replace_substring_regex(s.a, _TAG, "")).to_numpy() < 0.85 * s.pc.binary_length(s.a).to_numpy())
    # items: marked lines that hold no whole sentence, and lines that begin alike
    many = np.bincount(run[marked], minlength=runs)[run] >= 2
    item = np.nonzero(marked & many)[0]
    sentence = np.zeros(s.n, bool)
    if len(item):
        sentence[item] = _prose([re.sub(_MARK_PY, "", lines[i], count=1) for i in item]) & ended[item] & (words[item] >= 7)
    listed = marked & many & ~sentence
    fields = np.bincount(run[field], minlength=runs)[run] >= 3
    listed |= field & (fields | (score >= STRUCTURED))
    listed |= ~marked & ~field & ~fluent & (score >= STRUCTURED)
    listed &= ~table
    # the other lines are joined, however they are wrapped, and cut into sentences
    pieces: list[str] = []
    owner: list[int] = []
    free = np.nonzero(~table & ~listed)[0]
    if len(free):
        starts = np.concatenate([[True], (np.diff(free) > 1) | (run[free][1:] != run[free][:-1])])
        bounds = [*np.nonzero(starts)[0].tolist(), len(free)]
        for b, e in zip(bounds, bounds[1:]):
            part = " ".join([lines[i].strip() for i in free[b:e].tolist()])
            new = [x for x in _CUT.split(part) if x and not x.isspace()]
            pieces += new
            owner += [int(doc[free[b]])] * len(new)
    prose = repeated = np.zeros(docs)
    if pieces:
        p, own = _Strings(pieces), np.array(owner)
        key = p.pc.utf8_lower(p.pc.utf8_trim_whitespace(p.pc.replace_substring_regex(p.a, r"\s+", " "))).dictionary_encode().indices.to_numpy()
        _, at, times = np.unique(own * (int(key.max()) + 1) + key, return_inverse=True, return_counts=True)
        again = times[at] >= 3
        n = p.length - p.of(BLANK)
        repeated = np.bincount(own, n * again, docs)
        prose = np.bincount(own, n * (_prose(pieces) & ~again), docs)
    t = _Strings(texts)
    total = t.length - t.of(BLANK)
    of = lambda x: np.bincount(doc, x, docs)
    most = lambda x: np.maximum.reduceat(x, np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0])
    n_words, n_lines = of(words), np.bincount(doc, minlength=docs)
    per = lambda a, b: a / np.maximum(1, b)
    letters = t.of(LETTER)
    return {
        "word_count": n_words.astype(np.int64), "mean_word_length": per(letters, n_words) * (n_words > 0), "symbol_share": (total - t.of(LETTER | NUMBER)) / total, "digit_share": t.of(DIGIT) / total,
        "end_punct_share": of(ended) / n_lines, "common_word_share": per(of(common), n_words), "line_count": n_lines, "aligned_lines": of(table & (aligned > 0)).astype(np.int64), "indent_period": most(np.where(recurring >= 0.5, period, 0)[run]),
        "length_autocorrelation": most(repeating), "structure_score": most(score), "table_share": of(size * table) / total, "list_share": of(size * listed) / total, "repeat_share": repeated / total, "prose_share": prose / total,
    }


_MARK_PY = re.compile(_MARK)
FIGURES = (
    "word_count bigint, mean_word_length double, symbol_share double, digit_share double, end_punct_share double, "
    "common_word_share double, line_count bigint, aligned_lines bigint, indent_period bigint, length_autocorrelation double, "
    "structure_score double, table_share double, list_share double, repeat_share double, prose_share double"
)


def text_quality(df: DataFrame, key: str, text: str, batch_chars: int = 2_000_000) -> DataFrame:
    """One row per row of ``df``: its key and the figures of its whole text.

    Null and blank texts have null figures; repeated rows have a row each; a very long text is one
    pass over its lines. Shares are of the non-blank characters, ``end_punct_share`` of the lines
    that are not blank. A key named like a figure gets ``_key`` behind it. Some ``batch_chars`` characters are measured at once, at least one text. No
    shuffle; other columns are not read.
    """
    from pyspark.sql import types as T

    figures = T.StructType.fromDDL(FIGURES)
    name = f"{key}_key" if key in figures.names else key
    schema = T.StructType([T.StructField(name, df.schema[key].dataType), *figures])
    names = figures.names

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64() if "bigint" in x else pa.float64() for x in FIGURES.split(", ")]
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < batch_chars):
                    chars += len(texts[end] or "")
                    end += 1
                part = texts[at:end]
                full = [i for i, x in enumerate(part) if x and not x.isspace()]
                place = np.full(len(part), -1)
                place[full] = np.arange(len(full))
                got = measure([part[i] for i in full]) if full else {n: np.zeros(0) for n in names}
                take = pa.array(place, mask=place < 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), *(pa.array(got[n]).cast(k).take(take) for n, k in zip(names, kinds))], names=schema.names)
                at = end

    return df.select(key, text).mapInArrow(run, schema)


def not_prose(df: DataFrame, key: str, text: str, most: float = 0.5) -> DataFrame:
    """The keys of texts of which more than ``most`` does not stand in sentences of running prose."""
    from pyspark.sql import functions as F

    return text_quality(df.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_k", "_t").where(F.col("prose_share") < 1 - most).select(F.col("_k").alias(key))
