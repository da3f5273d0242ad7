"""Shared column helpers: Unicode-aware whitespace, word boundaries, lexicon scans.

Short lexicon scans are chains of ``contains``; longer ones loop over a literal array with the text
bound once (:func:`let`).  Both took the same time here on 109 terms, four times less than one
alternation regex, but a long chain makes generated methods that the JIT refuses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One class for Unicode whitespace that means the same to Java and to RE2.
WS_INNER = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
WS = f"[{WS_INNER}]"
NON_WS = f"[^{WS_INNER}]"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + (
    "    　"
)
# Lists up to this length become a chain of ``contains``.
SHORT_LIST = 8
# Word boundaries are spelled out: the meaning of \b depends on the JDK version.
WORD = r"[\p{L}\p{N}_]"
WORD_START = f"(?<!{WORD})"
WORD_END = f"(?!{WORD})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def balanced(op, items: Iterable[Column]) -> Column:
    items = list(items)
    while len(items) > 1:
        items = [op(*items[i : i + 2]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


def quote(term: str) -> str:
    return r"\Q" + term + r"\E"


def quote_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def whole_word(alternatives: Iterable[str]) -> str:
    return f"{WORD_START}(?:{'|'.join(quote(a) for a in alternatives)}){WORD_END}"


def whole_word_any_case(alternatives: Iterable[str]) -> str:
    """Without case the iota below a Greek vowel is the letter iota, so it is part of a word."""
    word = WORD.replace("_", r"_\x{345}")
    return f"(?iu)(?<!{word})(?:{'|'.join(quote(a) for a in alternatives)})(?!{word})"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, WS + "+", " ")


def words(c: Column) -> Column:
    """Whitespace words; blank text gives an empty array."""
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NON_WS + "+"))


def distinct_words(lower: Column) -> Column:
    return F.size(F.array_distinct(words(lower)))


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literals(terms) -> Column:
    """Literal array; one parsed expression instead of one call into the JVM per term."""
    return F.expr(f"array({', '.join(map(sql_text, terms))})")


def any_of(c: Column, terms: Iterable[str]) -> Column:
    """True when any term is a substring."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(False)
    if len(terms) > SHORT_LIST:
        return let(c, lambda x: F.exists(_literals(terms), lambda t: x.contains(t)))
    return balanced(lambda a, b: a | b, [c.contains(t) for t in terms])


def all_of(c: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [c.contains(t) for t in terms])


def hits(c: Column, terms: Iterable[str], weight: int = 1) -> Column:
    """Number of listed terms that are substrings (a term listed twice counts twice)."""
    terms = list(terms)
    if not terms:
        return F.lit(0)
    if len(terms) > SHORT_LIST:
        return let(c, lambda x: F.size(F.filter(_literals(terms), lambda t: x.contains(t)))) * F.lit(weight)
    return balanced(lambda a, b: a + b, [F.when(c.contains(t), weight).otherwise(0) for t in terms])


def occurrences(c: Column, terms: Iterable[str]) -> Column:
    """Sum over terms of non-overlapping occurrences; a miss costs one substring search."""
    terms = list(terms)
    if not terms:
        return F.lit(0)

    def one(x: Column, t: Column, size: Column) -> Column:
        gone = F.length(x) - F.length(F.replace(x, t, F.lit("")))
        return F.when(x.contains(t), (gone / size).cast("int")).otherwise(0)

    if len(terms) > SHORT_LIST:
        listed = F.expr(f"array({', '.join(f'struct({sql_text(t)} AS t, {len(t)} AS n)' for t in terms)})")
        return let(c, lambda x: F.aggregate(listed, F.lit(0), lambda acc, t: acc + one(x, t["t"], t["n"])))
    return balanced(lambda a, b: a + b, [one(c, F.lit(t), F.lit(len(t))) for t in terms])


def starts_with_any(c: Column, prefixes: Iterable[str]) -> Column:
    return balanced(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def matches_any(c: Column, patterns: Iterable[Iterable[str]]) -> Column:
    return balanced(lambda a, b: a | b, [c.rlike(whole_word(p)) for p in patterns])


def first_match(c: Column, table: dict[str, Iterable[str]], default: str | None) -> Column:
    """Key of the first entry, in order, with a substring hit."""
    out = None
    for key, terms in table.items():
        cond = any_of(c, terms)
        out = F.when(cond, key) if out is None else out.when(cond, key)
    return out.otherwise(F.lit(default))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def lookup(key: Column, mapping: dict[str, float], default: float) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(float(v))) if out is None else out.when(key == k, F.lit(float(v)))
    return out.otherwise(F.lit(float(default)))


def moment(df: DataFrame, ts: str, value) -> Column:
    """A point in time in the type of the column, so that the comparison reaches the Parquet scan."""
    return (value if isinstance(value, Column) else F.lit(value)).cast(df.schema[ts].dataType)
