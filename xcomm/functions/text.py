"""Column expressions over text: mention parsing (F1–F3), tokens (F5–F7), clean-up.

All are built-in Spark expressions (JVM side, whole-stage codegen); no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the referral workload.
MARKER = "/r/"
# Stop marks that end a community name, in the priority order of the "no space" rule (Q4).
STOP_MARKS = ["!", ")", "]", ".", "?", ",", '"']
EDIT_WORD = "edit"
BOT_SENTENCE = "I am a bot, and this action was performed automatically"
PLACEHOLDERS = ["[removed]", "[deleted]"]
# Characters replaced by a space before the embedding tokens are split.
EMBED_PUNCT = ';:"-,./()'
# English stop words (the NLTK list, 179 words), dropped from embedding tokens.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn "
    "doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Word characters as in Python's Unicode ``\w`` (letters, digits, underscore).  Written as an
# explicit class so Java and RE2 (DuckDB) agree; plain Java ``\w`` is ASCII-only.
WORD = r"[\p{L}\p{N}_]"
WORD_TOKEN = WORD + "+"  # count-bag tokens, case kept
VECTORIZER_TOKEN = WORD + "{2,}"  # words of two or more characters (after lower-casing)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/-" else ch for ch in s)


def name_piece(body, marker: str = MARKER) -> Column:
    """Text after the first ``marker`` up to the next '/', then up to the first newline."""
    b = _col(body)
    after = F.substring(b, F.instr(b, marker) + F.lit(len(marker)), F.lit(1 << 30))
    return F.substring_index(F.substring_index(after, "/", 1), "\n", 1)


def mention_target(body, marker: str = MARKER, strict: bool = True) -> Column:
    """the community a body points to (null when the marker is absent).

    A piece holding a space is cut at the space and then at the earliest stop mark.  A piece
    without a space is cut once, at the first stop mark present in the priority order of
    ``STOP_MARKS`` (``strict``); ``strict=False`` uses the earliest mark in both cases.
    """
    b = _col(body)
    # the piece is bound once by a lambda, so the many rules below do not copy its expression
    found = F.transform(F.array(name_piece(b, marker)), lambda piece: _cut_piece(piece, strict))
    return F.when(F.contains(b, F.lit(marker)), F.element_at(found, 1))


def _cut_piece(piece: Column, strict: bool) -> Column:
    earliest = F.regexp_extract(piece, "^[^" + _regex_escape("".join(STOP_MARKS)) + "]*", 0)
    spaced = F.regexp_extract(F.substring_index(piece, " ", 1), "^[^" + _regex_escape("".join(STOP_MARKS)) + "]*", 0)
    if strict:
        chain = None
        for m in STOP_MARKS:
            cut = F.substring_index(piece, m, 1)
            chain = F.when(F.instr(piece, m) > 0, cut) if chain is None else chain.when(F.instr(piece, m) > 0, cut)
        no_space = chain.otherwise(piece)
    else:
        no_space = earliest
    return F.when(F.instr(piece, " ") > 0, spaced).otherwise(no_space)


def mention_target_simple(body, marker: str = MARKER) -> Column:
    """text after the first marker up to the next '/' or space (Q3 fixed: no space ⇒ whole)."""
    b = _col(body)
    after = F.substring(b, F.instr(b, marker) + F.lit(len(marker)), F.lit(1 << 30))
    return F.when(F.instr(b, marker) > 0, F.substring_index(F.substring_index(after, "/", 1), " ", 1))


def mention_count(body, marker: str = MARKER, piece: str = "r") -> Column:
    """pieces equal to ``piece`` when the text from the first marker on is split at '/'."""
    b = _col(body)
    tail = F.substring(b, F.instr(b, marker), F.lit(1 << 30))
    parts = F.split(tail, "/", -1)
    return F.when(F.instr(b, marker) > 0, F.size(F.filter(parts, lambda x: x == F.lit(piece)))).otherwise(F.lit(0))


def clean_text(c) -> Column:
    """Missing text and the removal placeholders become a single space."""
    x = _col(c)
    return F.when(x.isNull() | x.isin(*PLACEHOLDERS), F.lit(" ")).otherwise(x)


def word_tokens(c) -> Column:
    """``\\w+`` tokens, case kept."""
    return F.regexp_extract_all(_col(c), F.lit(WORD_TOKEN), 0)


def vectorizer_tokens(c) -> Column:
    """lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(VECTORIZER_TOKEN), 0)


def embed_tokens(c, stop_words: list[str] | None = None) -> Column:
    """strip, lower-case, punctuation → space, split on single spaces, drop stop words, empty
    tokens and tokens holding two carriage returns.  Only the space splits: tabs and newlines
    stay inside tokens, as in the reference."""
    stop = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    x = F.lower(F.regexp_replace(_col(c), r"^\s+|\s+$", ""))
    x = F.translate(x, EMBED_PUNCT, " " * len(EMBED_PUNCT))
    toks = F.split(x, " ", -1)

    def keep(t):
        ok = (t != F.lit("")) & (F.instr(t, "\r\r") == 0)
        return ok & ~t.isin(*stop) if stop else ok  # a literal IN list becomes a hash-set lookup

    return F.filter(toks, keep)
