"""Text cleaning, counting and splitting as Column functions. White space is Unicode's, U+001C to U+001F included."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: The characters of SPACE with (?U), one by one (fixed values).
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Ligatures and what they stand for (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ĳ": "ij", "Ĳ": "IJ"}
#: What a line with a page number looks like (fixed values).
PAGE_NUMBER = (r"^[-–—\s]*\d{1,4}[-–—\s]*$", r"(?i)^page\s+\d+(\s+(of|/)\s+\d+)?$", r"^\d+\s*/\s*\d+$")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(SPACES))


def unix_lines(c) -> Column:
    return F.regexp_replace(_col(c), "\r\n?", "\n")


#: Control characters but tab and line ends.
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def clean_text(c, strict: bool = False) -> Column:
    """Line ends to LF, other white space to one space, at most one blank line in a row, no white space around.

    strict: control characters go, and lines end without white space (blank lines of spaces count as blank then).
    """
    one = F.regexp_replace(unix_lines(F.regexp_replace(_col(c), _CONTROL, "") if strict else c), r"(?U)[[\s\x1c-\x1f]&&[^\n]]+", " ")
    one = F.regexp_replace(one, " +(?=\n)", "") if strict else one
    return strip(F.regexp_replace(one, "\n{3,}", "\n\n"))


def nfc(c) -> Column:
    """Canonical composition, for which Spark has no expression. No text changes without a character from U+0300 on, where
    combining marks begin; only the others go to Python."""

    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if not isinstance(x, str) else unicodedata.normalize("NFC", x))

    c = _col(c)
    return F.coalesce(F.pandas_udf(compose, "string")(F.when(c.rlike(r"[^\x00-\x{2FF}]"), c)), c)


def fix_encoding(c) -> Column:
    return unix_lines(F.regexp_replace(nfc(c), _CONTROL, ""))


def drop_cid(c) -> Column:
    return _once(_col(c), lambda c: F.when(c.contains("(cid:") | c.contains("\ufffd"), F.regexp_replace(c, r"\(cid:\d+\)|\x{FFFD}", "")).otherwise(c))


def fix_ligatures(c) -> Column:
    def fixed(c: Column) -> Column:
        whole = c
        for k, v in LIGATURES.items():
            whole = F.replace(whole, F.lit(k), F.lit(v))
        return F.when(c.rlike(f"[{''.join(LIGATURES)}]"), whole).otherwise(c)  # few texts hold any

    return _once(_col(c), fixed)


def join_hyphens(c) -> Column:
    return _once(_col(c), lambda c: F.when(c.contains("-\n"), F.regexp_replace(c, r"(?U)(\w)-\n(\s*)([a-z])", "$1$3")).otherwise(c))


def tidy_spaces(c) -> Column:
    c = F.regexp_replace(_col(c), r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"(?<!\n) {2,}", " ")


def is_page_number(line: Column, *, stripped: bool = False) -> Column:
    one = "|".join(f"(?:{p})" for p in PAGE_NUMBER)
    return F.coalesce(line.rlike("[0-9]") & (line if stripped else strip(line)).rlike(one), F.lit(False))  # few lines have a digit


def drop_page_numbers(c) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~is_page_number(x)), "\n")


def drop_lines(c, drop: Column) -> Column:
    """Without the lines that, stripped, are in the array."""
    return F.array_join(F.filter(lines(c), lambda x: ~F.coalesce(F.array_contains(drop, strip(x)), F.lit(False))), "\n")


def drop_lines_and_numbers(c, drop: Column) -> Column:
    """drop_page_numbers of drop_lines, in one pass over the lines."""
    return F.array_join(F.filter(lines(c), lambda x: ~F.coalesce(F.array_contains(drop, strip(x)), F.lit(False)) & ~is_page_number(x)), "\n")


def lines(c) -> Column:
    return F.split(_col(c), "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")


def clean_raw(c) -> Column:
    return strip(tidy_spaces(join_hyphens(fix_ligatures(drop_cid(fix_encoding(c))))))


def clean_page(c, repeated: Column) -> Column:
    return strip(tidy_spaces(drop_lines_and_numbers(join_hyphens(fix_ligatures(drop_cid(fix_encoding(c)))), repeated)))


def clean_meta(c) -> Column:
    s = strip(c)
    return F.when(s.isin("", "None", "null"), None).otherwise(clean_raw(c))


def is_scanned(c) -> Column:
    """Whether a page has too little text to be more than an image."""
    return F.length(strip(c)) < 30


def rewrite_query(c) -> Column:
    return strip(F.regexp_replace(_col(c), rf"(?U){SPACE}+", " "))


def words(c) -> Column:
    return F.filter(F.split(_col(c), rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c)).cast("long")


def tokens_of_words(n: Column) -> Column:
    """The token estimate for a number of words."""
    return F.greatest(F.lit(1), F.bround(n / 0.75)).cast("long")


def token_count(c) -> Column:
    return tokens_of_words(word_count(c))


def sentences(c) -> Column:
    return F.filter(F.transform(F.split(strip(c), rf"(?U)(?<=[.!?]){SPACE}+(?=[A-Z])"), strip), lambda s: s != "")


def long_words(c) -> Column:
    """The set of words of four letters and more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)\b\w{4,}\b"), 0))


def terms(c) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)\w+"), 0)


def support(claim, source) -> Column:
    """The share of the claim's long words that the source has too."""
    a, b = long_words(claim), long_words(source)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _pad(row: Column, width: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))


def _once(value: Column, f) -> Column:
    """f(value), where value is worked out once however often f uses it, inside lambdas too."""
    return F.transform(F.array(value), f)[0]


def table_to_markdown(rows: Column, strict: bool = False) -> Column:
    """An array of rows as a Markdown table as wide as its header: short rows are padded, long ones cut."""
    if strict:
        rows = F.transform(rows, lambda r: F.transform(r, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))))

    def built(rows: Column, width: Column) -> Column:
        body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: _row(F.slice(_pad(r, width), F.lit(1), width)))
        out = F.array_join(F.concat(F.array(_row(rows[0]), _row(F.array_repeat(F.lit("---"), width))), body), "\n")
        return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "").otherwise(out)

    return _once(rows, lambda rs: _once(F.size(F.try_element_at(rs, F.lit(1))), lambda width: built(rs, width)))


def page_table_to_markdown(rows: Column) -> Column:
    """As wide as the widest row; null cells are empty, white space in cells becomes one space."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda x: rewrite_query(F.coalesce(x, F.lit("")))))

    def padded(rs: Column) -> Column:
        return _once(F.array_max(F.transform(rs, F.size)), lambda width: F.transform(rs, lambda r: _pad(r, width)))

    return table_to_markdown(_once(clean, padded))
