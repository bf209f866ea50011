"""String expressions shared by every stage.

Everything here stays in generated JVM code except the part of Unicode
compatibility folding that Spark has no expression for (see ``nfkc``).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Send the Arrow helpers of this module to executors by value: they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The characters a Python ``str.strip()`` removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java character class; use together with the (?U) flag.
SPACE_CLASS = r"[\s\x1c-\x1f]"

# Fixed value: runs of characters that end a sentence.
SENTENCE_ENDS = "[。！？!?\n;；]+"

# Joins several texts into one so that a single pass can read them all.  Private-use,
# so no fact or style pattern can match across it and NFKC leaves it alone.
JOINER = "\ue000"

_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
# Characters that NFKC maps to themselves in any context: ASCII, the common CJK block,
# a few dashes, quotes and brackets, and the joiner.
_INERT = (
    "^[\\x00-\\x7F\\u2014\\u2018\\u2019\\u201C\\u201D\\u3001\\u3002\\u3008-\\u3011"
    "\\u3014\\u3015\\u4E00-\\u9FFF\\uE000]*\\z"
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(as_col(value), F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    The optimiser copies an expression into every place that refers to it (a filter
    pushed below its projection, merged projections); behind a lambda variable it cannot.
    """
    return F.transform(F.array(value), body)[0]


def strip(value: Column | str) -> Column:
    """Both-end strip of Unicode whitespace (``trim`` alone only knows the space).

    ``trim`` with a set of characters lists all characters of the text, so only a text with a
    space at an end, or an empty one, goes there.
    """

    def edged(text: Column) -> Column:
        first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
        at_an_end = F.contains(F.lit(SPACES), first) | F.contains(F.lit(SPACES), last)
        return F.when(at_an_end, F.trim(text, F.lit(SPACES))).otherwise(text)

    return bind(as_col(value), edged)


def stripped(value: Column | str) -> Column:
    """Null, missing and whitespace-only all become the empty string."""
    return strip(text_or_empty(value))


def is_blank(value: Column | str) -> Column:
    return stripped(value) == ""


def first_non_empty(*values: Column | str) -> Column:
    """First value that is neither null nor empty; empty string when there is none."""
    return F.coalesce(*[F.nullif(as_col(v), F.lit("")) for v in values], F.lit(""))


def without_spaces(value: Column | str) -> Column:
    return F.regexp_replace(as_col(value), f"(?U){SPACE_CLASS}+", "")


def char_length(value: Column | str) -> Column:
    return F.char_length(as_col(value))


def question_id(query: Column | str) -> Column:
    """Content key of a question: the first 12 hex digits of its SHA-1."""
    return F.substring(F.sha1(text_or_empty(query)), 1, 12)


def filled_question_id(qid: Column | str, query: Column | str) -> Column:
    """Keep a given key, derive it from the question when it is null or empty."""
    return F.coalesce(F.nullif(as_col(qid), F.lit("")), question_id(query))


def seeded_hash(seed: int | str, key: Column | str) -> Column:
    """Deterministic pseudo-random order: a hex digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_col(key).cast("string")))


@F.arrow_udf(StringType())
def _nfkc_rare(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return texts.cast(pa.string())
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


_CHARS = 1 << 18  #: characters that a Python helper reads together


def text_groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``_CHARS`` characters; a longer text is alone."""
    return length_groups([len(t) for t in texts])


def length_groups(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """The same for texts of these lengths."""
    at, held = 0, 0
    for k, n in enumerate(lengths):
        if k > at and held + n > _CHARS:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(lengths):
        yield at, len(lengths)


def fold_joined(joined: str, mark: str) -> str:
    """NFKC of texts that a private-use ``mark`` joins.

    Wide ASCII, which folds character by character, is replaced first; then only the texts that
    are still not normal are folded one by one.
    """
    for wide, narrow in zip(_FULL_WIDTH, _HALF_WIDTH):
        if wide in joined:
            joined = joined.replace(wide, narrow)
    if unicodedata.is_normalized("NFKC", joined):
        return joined
    return mark.join(
        t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in joined.split(mark)
    )


def contains_any(value: Column | str, pattern: str) -> Column:
    """Does a text hold a match of a pattern in RE2 syntax?  Linear in the text, whatever the number of alternatives.

    Meant for many plain words at once, which the JVM's engine tries one by one at every
    character; it shares its Python stage with ``nfkc``.
    """

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return found(as_col(value))


def nfkc(value: Column | str) -> Column:
    """Full Unicode NFKC.

    Full-width ASCII is folded by ``translate``; a text that then holds only inert
    characters is finished without leaving the JVM.  Only the remaining rows carry
    their text to the Arrow helper, the others send a null.
    """
    raw = text_or_empty(value)
    folded = F.translate(raw, _FULL_WIDTH, _HALF_WIDTH)
    inert = folded.rlike(_INERT)
    return F.coalesce(_nfkc_rare(F.when(~inert, raw)), folded)


def char_before_last(text: Column, tag: str) -> Column:
    """Everything before the last ``tag``; callers check that ``tag`` occurs."""
    tail = F.substring_index(text, tag, -1)
    return F.substring(text, F.lit(1), F.char_length(text) - F.char_length(tail) - F.lit(len(tag)))


def rest_from(text: Column, position: Column) -> Column:
    """Suffix starting at a 1-based character position."""
    return F.substring(text, position, F.lit(2147483647))


def sentences(value: Column | str) -> Column:
    """Split on CJK and ASCII sentence ends, strip, drop blanks."""
    parts = F.split(text_or_empty(value), SENTENCE_ENDS)
    return F.filter(F.transform(parts, strip), lambda s: s != "")
