"""Toxicity with noisy-channel deobfuscation.

Texts are folded to plain lower-case letters; words of other scripts are features as they are.  Spans that look disguised (digits or symbols among
letters, letters spaced out, words cut in short chunks, letters repeated) become character lattices: every observed sign
offers the letters that it may stand for, or nothing, each at a channel cost.  A Viterbi search
under a character 4-gram model of the whole corpus restores the likeliest letters; the restored
text is then scored by a word model fitted on labelled rows, whose features are the words as they
are and without repeated letters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .additive_model import bounded_sample
from .common import staged
from .textbytes import text_slices

#: Expected number of labelled rows that the word model is fitted on (the bound of the sample).
SAMPLE_ROWS = 30_000
#: Words that may enter the word model, and boosting steps that pick among them.
CANDIDATES = 5_000
STEPS = 400
#: A candidate occurs in this many toxic texts of the sample at least.
LEAST_TEXTS = 3

LETTERS = 27  # 0: no letter; 1 .. 26: a .. z
ORDER = 4
#: Weight of the next shorter context in the language model.
BACKOFF = 4.0

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h", "&": "a", "%": "o", "*": "abcdefghijklmnopqrstuvwxyz",
}
#: Signs that may only be put between letters.
SEPARATORS = " .-_~^'`\"*,:;/\\=|"
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "ß": "s", "æ": "a", "œ": "o", "€": "e",
    "£": "l", "¥": "y", "¢": "c", "µ": "u", "©": "c", "®": "r",
}

#: Channel costs (log probabilities).
SAME = math.log(0.95)
STANDS_FOR = math.log(0.6)
REPEATED = math.log(0.5)
DOUBLED = math.log(1e-4)
JOINED = math.log(0.9)
SPLIT = math.log(0.05)
DROPPED = math.log(0.02)
#: A blank inside a word that was cut in chunks.
CUT = math.log(1e-3)
#: Letters of such a chunk at most, and the share of ``CUT`` that a join must gain to be decoded.
CHUNK = 4
LIKELY = 0.5
#: States that the search keeps at each sign (a censored letter opens many).
BEAM = 256


def _folding() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: the folded sign, or 0 for nothing; whether it belongs to a word of another
    script; and whether it is a letter that has no Latin form."""
    table, wordy, other = np.full(0x110000, ord(" "), np.uint8), np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    table[:128] = [c if c >= 32 else 32 for c in range(128)]
    table[65:91] = np.arange(97, 123)
    table[10] = 10
    near = {*range(0xA0, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)}
    # letters of further scripts and styled ones are in the first four planes, signs without a form in the 15th
    for cp in [*range(0xA0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x17000), *range(0x18D00, 0x20000), *range(0xE0000, 0xE0200)]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co"):
            continue
        form = LOOKALIKES.get(ch.lower()) or unicodedata.normalize("NFKD", ch.lower() if cp in near else ch)
        plain = form[:1] if cp in near else "".join(c for c in form if not unicodedata.combining(c)).strip("()")
        plain = LOOKALIKES.get(plain.lower(), plain).lower()
        if len(plain) == 1 and 32 < ord(plain) < 127 and (cp in near or plain.isalnum()):
            table[cp] = ord(plain)
        elif kind in ("Mn", "Me", "Cf"):
            table[cp] = 0
        wordy[cp] = kind[0] in "LM"
    for first in (0x1F150, 0x1F170):  # letters in filled circles and squares
        table[first : first + 26] = np.arange(97, 123)
    for first, last in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x17000, 0x18D00), (0x20000, 0x32000)):  # letters throughout
        wordy[first:last] = [unicodedata.category(chr(cp))[0] == "L" for cp in range(first, last)]
    for ch in LOOKALIKES:
        table[ord(ch)] = ord(LOOKALIKES[ch])
    for cp in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        table[cp] = 0
    for cp in (0x2018, 0x2019):
        table[cp] = ord("'")
    wordy[0x200C:0x200E] = True  # joiners stand inside words
    other[:] = wordy & (table == ord(" "))
    return table, wordy, other


FOLD, WORDY, OTHER = _folding()
CODE = np.zeros(256, np.int64)
CODE[97:123] = np.arange(1, 27)
_IS_LETTER = CODE > 0
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[ord(c) for c in set(LEET) | set(SEPARATORS) - {" "}]] = True
_IS_EDGE = np.zeros(256, bool)
_IS_EDGE[[ord(c) for c in "0123456789@$"]] = True
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[10, 32]] = True


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with document offsets as folded signs, one byte per character, with offsets.
    Every document is closed by a line break, so nothing runs across documents."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    signs = FOLD[points]
    keep = signs != 0
    places = np.concatenate([[0], np.cumsum(keep)])[lead]
    signs = signs[keep]
    n = len(offsets) - 1
    closed = np.insert(signs, places[1:], np.full(n, 10, np.uint8))
    return closed, places + np.arange(n + 1)


def suspicious_spans(signs: np.ndarray) -> list[tuple[int, int]]:
    """Spans of ``signs`` to decode: whole tokens, or runs of single letters, in order, disjoint."""
    n = len(signs)
    if n < 3:
        return []
    letter = np.zeros(n + 8, bool)
    letter[4 : n + 4] = _IS_LETTER[signs]
    sign = np.zeros(n + 8, bool)
    sign[4 : n + 4] = _IS_SIGN[signs]
    at = lambda flags, k: flags[4 + k : n + 4 + k]
    here, before, after = at(sign, 0), at(letter, -1), at(letter, 1)
    inner = here & before & (after | (at(sign, 1) & (at(letter, 2) | (at(sign, 2) & at(letter, 3)))))
    edge = np.zeros(n + 8, bool)
    edge[4 : n + 4] = _IS_EDGE[signs]
    ends = at(edge, 0) & ((after & ~at(sign, -2)) | (before & ~at(sign, 2)))
    twice = np.zeros(n + 4, bool)
    twice[: n - 1] = (signs[:-1] == signs[1:]) & _IS_LETTER[signs[:-1]]
    # a letter three times, or three letters in a row twice each
    same = (twice[:n] & twice[1 : n + 1]) | (twice[:n] & twice[2 : n + 2] & twice[4 : n + 4])
    marks = np.flatnonzero(inner | ends | same)
    spans = []
    if len(marks):
        blanks = np.flatnonzero(_IS_BLANK[signs])
        k = np.searchsorted(blanks, marks)
        lo = np.where(k > 0, blanks[np.maximum(k - 1, 0)] + 1, 0) if len(blanks) else np.zeros(len(marks), np.int64)
        hi = np.where(k < len(blanks), blanks[np.minimum(k, len(blanks) - 1)], n) if len(blanks) else np.full(len(marks), n)
        first = np.concatenate([[True], lo[1:] != lo[:-1]])
        spans = list(zip(lo[first].tolist(), hi[first].tolist(), strict=True))
    glyph = letter | edge
    lone = at(glyph, 0) & ~at(glyph, -1) & ~at(glyph, 1)
    # three lone glyphs or more, one after the other in a line, whatever the gaps
    place = np.flatnonzero(at(glyph, 0))
    single, line = lone[place], np.cumsum(signs == 10)[place]
    linked = single[1:] & single[:-1] & (line[1:] == line[:-1])
    if linked.any():
        steps = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
        first, last = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        runs = [(a, b + 1) for a, b in zip(place[first].tolist(), place[last].tolist(), strict=True)]
        runs = [r for r, k in zip(runs, (last - first).tolist(), strict=True) if k >= 2 and letter[4 + r[0] : 4 + r[1]].any()]
        spans = _disjoint(sorted([*spans, *runs]))
    return spans


def chunk_spans(signs: np.ndarray, model: np.ndarray) -> list[tuple[int, int]]:
    """Runs of short chunks of letters in a line, one of whose blanks the language model would rather
    be without.  The run takes in the short chunks next to it, which may belong to the word."""
    blank = _IS_BLANK[signs]
    edge = np.diff(np.concatenate([[1], blank.astype(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size, letters, lines = end - start, np.concatenate([[0], np.cumsum(_IS_LETTER[signs])]), np.concatenate([[0], np.cumsum(signs == 10)])
    short = (size <= CHUNK) & (letters[end] - letters[start] == size)
    side = short[:-1] & short[1:] & (lines[end[:-1]] == lines[start[1:]])
    k = np.flatnonzero(side)
    if not len(k):
        return []
    c = CODE[signs]
    last, first, left, right = end[k] - 1, start[k + 1], size[k], size[k + 1]
    a1, a2, a3 = c[last], np.where(left > 1, c[last - 1], 0), np.where(left > 2, c[last - 2], 0)
    top = len(c) - 1
    b1, b2, b3 = c[first], np.where(right > 1, c[np.minimum(first + 1, top)], 0), np.where(right > 2, c[np.minimum(first + 2, top)], 0)
    after = lambda x, y, z, to: model[(x * LETTERS + y) * LETTERS + z, to]
    more = right > 1
    joined = after(a3, a2, a1, b1) + after(a2, a1, b1, b2) + more * after(a1, b1, b2, b3)
    zero = np.zeros_like(a1)
    split = after(a3, a2, a1, zero) + after(a2, a1, zero, b1) + after(a1, zero, b1, b2) + more * after(zero, b1, b2, b3)
    spans = []
    for i in k[joined - split > -CUT * LIKELY].tolist():
        lo, hi = i, i + 1
        while lo > 0 and i - lo < CHUNK and side[lo - 1]:
            lo -= 1
        while hi < len(side) and hi - i < CHUNK and side[hi]:
            hi += 1
        spans.append((int(start[lo]), int(end[hi])))
    return _disjoint(sorted(spans))


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def lattice(span: str) -> list[list[tuple[int, float]]]:
    """For each sign of a span its readings ``(letter 1..26, 0: word break, -1: nothing; cost)``."""
    core = span.strip(SEPARATORS + "!?#%&$*<>()[]{}")
    start = span.find(core) if core else 0
    end = start + len(core)
    # one or two marks next to the core may be letters, longer runs are decoration
    near = range(start - 2 if start <= 2 else start, end + 2 if len(span) - end <= 2 else end)
    pieces = core.translate(str.maketrans("-._*", "    ")).split()
    lone = bool(core) and all(len(p) == 1 for p in pieces)
    chunked = len(pieces) > 1 and all(len(p) <= CHUNK for p in pieces)
    doubled = sum(a == b for a, b in zip(core, core[1:], strict=False)) * 5 >= len(core) * 2
    out = []
    for i, ch in enumerate(span):
        code = int(CODE[ord(ch)])
        again = i > 0 and span[i - 1] == ch
        run = again and (doubled or span[i - 2 : i] == ch * 2 or span[i - 1 : i + 2] == ch * 3)
        if code:
            options = [(code, SAME)]
            if again:
                options.append((-1, REPEATED if run else DOUBLED))
        elif not start <= i < end:
            options = [(0, SAME)]
            if i in near and ch in "$!":
                options += [(int(CODE[ord(x)]), STANDS_FOR - math.log(len(LEET[ch]))) for x in LEET[ch]]
        else:
            options = []
            if ch == " " and chunked and not lone:
                options += [(0, SAME), (-1, SAME if again else CUT)]
            elif ch in SEPARATORS:
                options += [(-1, JOINED), (0, SPLIT)] if lone or ch != " " else [(0, SAME)]
            if ch in LEET and not (ch == "*" and lone):
                options += [(int(CODE[ord(x)]), STANDS_FOR - math.log(len(LEET[ch]))) for x in LEET[ch]]
                if again:
                    options.append((-1, REPEATED if run else DOUBLED))
            if not options:
                options = [(0, SAME), (-1, DROPPED)]
            elif ch not in SEPARATORS:
                options.append((0, DROPPED))
        out.append(options)
    return out


def viterbi(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a span as letters and spaces.  ``model[context, next]``: log
    probabilities, a context being the last three codes in base 27."""
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    wrap = LETTERS ** (ORDER - 1)
    for options in lattice(span):
        new: dict[int, tuple[float, tuple]] = {}
        for context, (cost, path) in states.items():
            for code, channel in options:
                if code < 0:
                    to, total, way = context, cost + channel, path
                else:
                    total = cost + channel + float(model[context, code])
                    to, way = (context * LETTERS + code) % wrap, (path, code)
                if to not in new or total > new[to][0]:
                    new[to] = (total, way)
        if len(new) > BEAM:
            new = dict(sorted(new.items(), key=lambda x: -x[1][0])[:BEAM])
        states = new
    best, path = max(((c + float(model[s, 0]), p) for s, (c, p) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, code = path
        letters.append(code)
    return "".join(chr(96 + c) if c else " " for c in reversed(letters))


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of the next letter after three, from counts over every text of ``docs``.

    Tasks count into one table of 27**4 cells; what meets on the driver are its non-empty cells,
    which the alphabet bounds."""
    cells = LETTERS**ORDER

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                signs, _ = folded(data, offsets)
                c = CODE[signs]
                if len(c) >= ORDER:
                    index = ((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:]
                    total += np.bincount(index, minlength=cells)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["cell", "n"])

    counts = docs.select(text).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(cells)
    table[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    table = table.reshape((LETTERS,) * ORDER)
    lower = np.full(LETTERS, 1 / LETTERS)
    for order in range(1, ORDER + 1):
        seen = table.sum(axis=tuple(range(ORDER - order))) if order < ORDER else table
        lower = (seen + BACKOFF * lower) / (seen.sum(axis=-1, keepdims=True) + BACKOFF)
    return np.log(lower).reshape(-1, LETTERS).astype(np.float32)


class Restorer:
    """Restores texts; spans met before are looked up, within ``MOST`` bytes."""

    MOST = 4 << 20
    #: What an entry takes besides its bytes.
    ENTRY = 160

    def __init__(self, model: np.ndarray):
        self.model, self.memory, self.size = model, {}, 0

    def span(self, span: bytes) -> bytes:
        found = self.memory.get(span)
        if found is None:
            found = viterbi(span.decode("ascii"), self.model).encode("ascii")
            size = len(span) + len(found) + self.ENTRY
            if self.size + size > self.MOST:
                self.memory.clear()
                self.size = 0
            if size <= self.MOST:
                self.memory[span] = found
                self.size += size
        return found

    def bags(self, column: pa.Array):
        """For each text of a column: its features, and the number of spans replaced."""
        for (body, n), text in zip(self.texts(column), column, strict=True):
            text = text.as_py() or ""
            yield (features(body) if text.isascii() else features(body) | other_words(text)), n

    def texts(self, column: pa.Array):
        """For each text of a column: folded bytes with disguised spans replaced, and their number."""
        for _, _, data, offsets in text_slices(column):
            signs, places = folded(data, offsets)
            spans = _disjoint(sorted([*suspicious_spans(signs), *chunk_spans(signs, self.model)]))
            body = signs.tobytes()
            k = 0
            for lo, hi in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
                if k >= len(spans) or spans[k][0] >= hi:
                    yield body[lo:hi], 0
                    continue
                parts, at, n = [], lo, 0
                while k < len(spans) and spans[k][0] < hi:
                    a, b = spans[k]
                    seen, k = body[a:b], k + 1
                    found = self.span(seen)
                    if found.split() != seen.split():
                        parts += [body[at:a], found]
                        at, n = b, n + 1
                parts.append(body[at:hi])
                yield b"".join(parts), n


_ONLY_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


#: Letters of a word start, and the counts from which it is a feature.
START = 4
TIMES = (1, 2, 3)


#: Letters of scripts that put no blanks between words: their texts give runs of one to three letters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U00031fff]+")


def other_words(text: str) -> set[bytes]:
    """Words of a text with letters that have no Latin form, in lower case and compatibility form."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    other = OTHER[points]
    found: set[bytes] = set()
    if not other.any():
        return found
    edge = np.diff(np.concatenate([[0], WORDY[points].astype(np.int8), [0]]))
    lead = np.concatenate([[0], np.cumsum(other)])
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    use = lead[hi] > lead[lo]
    words = {text[a:b] for a, b in zip(lo[use].tolist(), hi[use].tolist(), strict=True)}
    for word in words:
        word = "".join(c for c in unicodedata.normalize("NFKC", word).casefold() if unicodedata.category(c) != "Cf")
        for run in _UNSPACED.findall(word):
            found.update(run[i : i + k].encode() for k in (1, 2, 3) for i in range(len(run) - k + 1))
        found.update(w.encode() for w in _UNSPACED.sub(" ", word).split())
    return found


_RUN = re.compile(rb"(.)\1+")


@lru_cache(20_000)
def single_letters(word: bytes) -> bytes:
    """A word with every run of one letter as one: the same for all its forms with repeated letters."""
    return _RUN.sub(rb"\1", word)


def features(restored: bytes) -> set[bytes]:
    """Features of a restored text: its words, each also without repeated letters, and how often
    words start alike (``start~2``: words that start so occur twice at least), for inflected forms
    of an insult."""
    words = Counter(restored.translate(_ONLY_LETTERS).split())
    starts: dict[bytes, int] = {}
    found = set(words)
    for w, n in words.items():
        if len(w) > START:
            starts[w[:START]] = starts.get(w[:START], 0) + n
        plain = single_letters(w)
        if plain != w:
            found.add(plain)
            if len(plain) > START and plain[:START] != w[:START]:
                starts[plain[:START]] = starts.get(plain[:START], 0) + n
    for t in TIMES:
        mark = b"~%d" % t
        found.update(s + mark for s, n in starts.items() if n >= t)
    return found


def restored_texts(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """``row`` (struct of all columns but the text), ``restored`` (folded text with disguised spans
    replaced) and ``n_spans``."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"))
    out = T.StructType([rows.schema["row"], T.StructField("restored", T.StringType()), T.StructField("n_spans", T.IntegerType())])

    def restore(batches):
        restorer = Restorer(model)
        for batch in batches:
            found = list(restorer.texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([f[0].decode("ascii").rstrip("\n") for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())],
                ["row", "restored", "n_spans"],
            )

    return rows.mapInArrow(restore, out)


@dataclass
class ToxicityModel:
    language: np.ndarray
    base: float
    weights: dict[bytes, float]


def train_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS
) -> ToxicityModel:
    """Language model from all texts of ``docs``; word model from about ``rows`` rows of ``labels``
    for which ``usable`` (a condition on the key) holds.

    Candidates (words and word starts) are those whose texts are toxic more often than by chance; boosting then takes
    the word that explains most of what is still unexplained, so words that only accompany an
    insult add nothing.  Null labels or keys are left out; without labelled rows every score is 0.5.
    """
    language = language_model(docs, text)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & usable)
    chosen = bounded_sample(known, key, rows).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")

    def bags(batches):
        restorer = Restorer(language)
        for batch in batches:
            sets = [sorted(w.decode() for w in found) for found, _ in restorer.bags(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(sets, pa.list_(pa.string()))], ["y", "words"])

    bag = sample.select("y", "text").mapInArrow(bags, "y int, words array<string>")
    bag = staged(bag.withColumn("id", F.monotonically_increasing_id()), "toxic-sample")
    classes = {r["y"]: r["n"] for r in bag.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)
    if not n1 + n0:
        return ToxicityModel(language, 0.0, {})
    word = bag.select("id", "y", F.explode("words").alias("word"))
    df = word.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    excess = F.col("a") - (F.col("a") + F.col("b")) * (n1 / (n1 + n0))
    strength = excess / F.sqrt((F.col("a") + F.col("b")) * (n1 / (n1 + n0)) + 1)
    picked = (
        df.where(f"a >= {LEAST_TEXTS}").withColumn("z", strength).where("z > 2").orderBy(F.desc("z"), "word").limit(CANDIDATES)
    )
    picked = staged(picked.select("word"), "toxic-words")
    names = sorted(picked.toArrow()["word"].to_pylist())
    number = picked.withColumn("k", (F.row_number().over(Window.orderBy("word")) - 1))
    hits = word.join(F.broadcast(number), "word").select("id", "k").toArrow()
    ys = bag.select("id", "y").toArrow()
    base, weight = boost(ys["id"].to_numpy(), ys["y"].to_numpy().astype(np.float64), hits["id"].to_numpy(), hits["k"].to_numpy(), len(names))
    return ToxicityModel(language, base, {names[k].encode(): float(weight[k]) for k in np.flatnonzero(weight)})


def boost(ids: np.ndarray, y: np.ndarray, hit_ids: np.ndarray, col: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Stagewise logistic fit: in each step the word of largest gain takes a Newton step."""
    order = np.argsort(ids)
    ids, y = ids[order], y[order]
    row = np.searchsorted(ids, hit_ids)
    by = np.lexsort((row, col))
    row, col = row[by], col[by]
    first = np.searchsorted(col, np.arange(n + 1))
    raw = np.full(len(y), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    base, weight = float(raw[0]), np.zeros(n)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-raw))
        shift = float((y - p).sum() / ((p * (1 - p)).sum() + 1))
        base, raw = base + shift, raw + shift
        if not n:
            continue
        p = 1 / (1 + np.exp(-raw))
        g = np.bincount(col, (y - p)[row], n)
        h = np.bincount(col, (p * (1 - p))[row], n) + 0.5
        gain = np.where(g > 0, g * g / h, 0)
        k = int(gain.argmax())
        if gain[k] < 1.0:
            break
        step = min(g[k] / h[k], 4.0)
        weight[k] += step
        raw[row[first[k] : first[k + 1]]] += step
    return base, weight


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Score whole texts: ``row`` (struct of all columns of ``docs`` but the text), ``score`` (0 to
    1), ``hits`` (words of the word model and word starts found in the restored text) and ``n_spans`` (spans
    restored).  Null and empty texts have no words and get the base score; equal texts get equal
    scores; an empty table gives an empty result."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"))
    out = T.StructType(
        [rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.StringType())), T.StructField("n_spans", T.IntegerType())]
    )

    def score(batches):
        restorer, known = Restorer(model.language), model.weights.keys()
        for batch in batches:
            scores, hits, spans = [], [], []
            for bag, n in restorer.bags(batch.column("text")):
                found = sorted(known & bag)
                raw = model.base + sum(model.weights[w] for w in found)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))))
                hits.append([w.decode() for w in found])
                spans.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(scores, pa.float64()), pa.array(hits, pa.list_(pa.string())), pa.array(spans, pa.int32())],
                ["row", "score", "hits", "n_spans"],
            )

    return rows.mapInArrow(score, out)


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is under ``threshold``.  Only texts go to Python, only
    verdicts come back."""
    limit = math.log(threshold / (1 - threshold))

    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer, known = Restorer(model.language), model.weights.keys()
        for column in texts:
            yield pa.array([model.base + sum(model.weights[w] for w in known & bag) < limit for bag, _ in restorer.bags(column)], pa.bool_())

    return docs.where(F.arrow_udf(clean, T.BooleanType())(docs[text]))
