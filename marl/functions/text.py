"""Text primitives as Column expressions. None of them leaves the JVM except nfc()."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon

ARABIC, LATIN = "\\u0600-\\u06FF", "A-Za-z"
#: What Python's strip() and split() take for white space, as members of a Java character class.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same as a plain string.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: White space after a stop; a blank is looked for first, as most places hold none.
STOP = f"[{SPACE}](?<=[.!؟][{SPACE}])[{SPACE}]*"
DIACRITICS = "[\\u064B-\\u065F\\u0670]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, body) -> Column:
    """body(c) with c evaluated once, however often body names it and wherever the optimizer moves it."""
    return F.transform(F.array(c), body)[0]


def two_places(c: Column) -> Column:
    """Rounded to two places, halves to even, by the value that the double has (0.575 is less than half a hundredth above 0.57)."""
    return F.rint(c * 100) / 100


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def squeeze(c: Column | str) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"[{SPACE}]+", " "))


def squeeze_chat(c: Column | str) -> Column:
    return squeeze(F.replace(col(c), F.lit("\x00"), F.lit("")))


def log_line(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[\\r\\n\\t]", " "), 1, 300)


def script_ratio(c: Column | str, script: str = ARABIC) -> Column:
    """Share of a text's code points that belong to a script, 0 for an empty text."""
    return count_of(c, script) / F.greatest(F.length(col(c)), F.lit(1))


def count_of(c: Column | str, members: str) -> Column:
    """Code points of a class, by what is left without its runs (fewer matches than code points)."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), f"[{members}]+", ""))


def reaches(c: Column | str, script: str, least: float) -> Column:
    """script_ratio(c, script) >= least. A text's beginning is counted first: where it holds so many already, the rest is not looked at. c is
    best a column or a variable (let), as it is named several times."""
    c = col(c)
    size = F.greatest(F.length(c), F.lit(1))
    whole = count_of(c, script) / size >= least
    beginning = F.substring(c, F.lit(1), F.ceil(size * (1.6 * least)).cast("int"))
    return (count_of(beginning, script) / size >= least) | whole if least < 0.5 else whole


def is_script_heavy(c: Column | str, least: float = 0.15, script: str = ARABIC) -> Column:
    return (F.length(col(c)) > 0) & reaches(c, script, least)


def is_valid_document(c: Column | str, script: str = ARABIC, least: float = 0.15, chars: int = 80) -> Column:
    return (F.length(col(c)) >= chars) & is_script_heavy(c, least, script)


def is_valid_content(c: Column | str, least: int = 250, most: int = 600_000, letters: int = 100) -> Column:
    return F.length(col(c)).between(least, most) & (count_of(c, LATIN + ARABIC) >= letters)


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def nfc(c: Column | str) -> Column:
    """Unicode normal form C. Only texts that hold a mark, a conjoining jamo or a code point with a canonical twin are sent to Python."""
    suspect = "[\\p{M}\\u1100-\\u11FF\\u0340-\\u0344\\u2000\\u2001\\u2126\\u212A\\u212B\\u2329\\u232A\\uF900-\\uFAFF\\uFB1D-\\uFB4E]"
    return F.coalesce(_nfc(F.when(col(c).rlike(suspect), col(c))), col(c))


def fold_letters(c: Column | str) -> Column:
    """Hamza forms to their letters, without diacritics; text must be in normal form C. Texts that hold none of them stay as they are."""
    folded = lambda x: F.regexp_replace(F.translate(x, lexicon.LETTERS, lexicon.FOLDED_LETTERS), DIACRITICS, "")
    return let(col(c), lambda x: F.when(x.rlike(f"[{lexicon.LETTERS}{DIACRITICS[1:-1]}]"), folded(x)).otherwise(x))


def normalize_question(c: Column | str) -> Column:
    """Lower case, ASCII digits, folded letters, no diacritics, tatweel or symbols, single blanks."""
    table = (lexicon.INDIC_DIGITS + lexicon.LETTERS + lexicon.CLOSED_TEH, lexicon.ASCII_DIGITS + lexicon.FOLDED_LETTERS + lexicon.FOLDED_TEH)
    c = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), *table)
    c = F.regexp_replace(c, "[\\u064B-\\u065F\\u0670\\u0640]", "")
    return squeeze(F.regexp_replace(c, f"[^\\p{{L}}\\p{{N}}_{SPACE}{ARABIC}]", " "))


def stem(c: Column | str) -> Column:
    """Words without vowel marks and tatweel, single blanks between them."""
    return squeeze(F.regexp_replace(col(c), "[\\u064B-\\u0652\\u0640]", ""))


def tokens(c: Column | str) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def lines(c: Column | str) -> Column:
    """Stripped lines, blank ones too."""
    return F.transform(F.split(col(c), BREAK), strip)


def split_sentences(c: Column | str, longer_than: int = 5) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), STOP), strip), lambda s: F.length(s) > longer_than)


def split_paragraphs(c: Column | str, least: int = 50) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), f"\\n+|{STOP}"), strip), lambda s: F.length(s) >= least)


def md5_text(c: Column | str) -> Column:
    return F.md5(col(c).cast("binary"))


def sha256_text(c: Column | str, chars: int | None = None) -> Column:
    return F.sha2((F.substring(col(c), 1, chars) if chars else col(c)).cast("binary"), 256)


def document_id(url: Column | str, text: Column | str) -> Column:
    return sha256_text(F.concat(F.coalesce(col(url), F.lit("")), F.substring(F.coalesce(col(text), F.lit("")), 1, 500)))


def pipeline_key(question: Column | str) -> Column:
    q = F.lower(strip(F.coalesce(col(question), F.lit(""))))
    return F.when(F.coalesce(col(question), F.lit("")) == "", F.lit("empty")).otherwise(sha256_text(q))


def analyzer_key(question: Column | str) -> Column:
    return md5_text(F.lower(strip(F.coalesce(col(question), F.lit("")))))
