"""Column expressions over text: patterns with explicit classes, quoting, suffix rules, number formats."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hilandera import constants as C

_SPACES = "".join(f"\\u{a:04X}" if a == b else f"\\u{a:04X}-\\u{b:04X}" for a, b in C.SPACE_POINTS)
SPACE = f"[{_SPACES}]"
WORD = f"[{C.WORD_CHARS}]"
TOKEN = f"{WORD}+|{SPACE}+|[^{C.WORD_CHARS}{_SPACES}]+"


def part(size: int) -> str:
    """A pattern whose matches, one after the other, are a text in parts of `size` characters or somewhat
    more: a part ends where a token does."""
    return f"(?s).{{1,{size}}}+(?:(?<={WORD}){WORD}*+|(?<={SPACE}){SPACE}*+|(?<=[^{C.WORD_CHARS}{_SPACES}])[^{C.WORD_CHARS}{_SPACES}]*+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def straight_quotes(text: Column | str) -> Column:
    """Typographic single and double quotes as ASCII ones."""
    return F.translate(col(text), "‘’‚‛“”„‟", "''''\"\"\"\"")


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def suffix_tag(word: Column | str) -> Column:
    """Part of speech by the first suffix that is shorter than the word; noun otherwise."""
    w, out = col(word), F.lit("n")
    for suffix, tag in reversed(C.SUFFIXES):
        out = F.when((F.length(w) > len(suffix)) & w.endswith(suffix), tag).otherwise(out)
    return out


def csv_field(value: Column | str) -> Column:
    """Quoted if it holds a comma, a quote or a newline; null is empty."""
    v = F.coalesce(col(value).cast("string"), F.lit(""))
    return F.when(v.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def xml_escaped(value: Column | str) -> Column:
    v = col(value)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(raw), F.lit(entity))
    return v


def fixed(digits: int):
    """A function that writes doubles with so many decimals: exact binary value, ties away from zero."""
    quantum = Decimal(1).scaleb(-digits)

    @F.pandas_udf("string")
    def write(values: pd.Series) -> pd.Series:
        # each distinct value is written once; missing ones have the number -1
        numbers, found = pd.factorize(values)
        texts = [*(str(Decimal(x or 0.0).quantize(quantum, ROUND_HALF_UP)) for x in found), None]
        return pd.Series(np.array(texts, object)[numbers], values.index, object)

    return write


def integer_key(word: Column | str) -> Column:
    """The number that a word of digits stands for, null for others: such words lead among equal counts, in numeric order."""
    w = col(word)
    n = F.when(w.rlike("^(0|[1-9][0-9]{0,9})$"), w.cast("bigint"))
    return F.when(n < 4294967295, n)


def clamped(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(value), F.lit(low)), F.lit(high))
