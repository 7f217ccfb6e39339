"""Scalar column expressions used across the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it runs
inside whole-stage codegen; no Python is evaluated per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
KEY_SEPARATOR = "|"            # dedup key = md5(source + "|" + link)
WORD_PATTERN = r"[\p{L}\p{N}_]+"   # a Unicode "\w+" run; Java and RE2 agree on it
WS_PATTERN = r"\s+"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- hashing

def dedup_key(source: str | Column = "source", link: str | Column = "link") -> Column:
    """md5 hex of ``source|link`` (null when either part is null)."""
    return F.md5(F.concat(col_(source), F.lit(KEY_SEPARATOR), col_(link)))


def sha256_hex(c: str | Column) -> Column:
    return F.sha2(col_(c), 256)


# ---------------------------------------------------------------- text

def collapse_ws(c: str | Column) -> Column:
    """Python ``re.sub(r"\\s+", " ", s.strip())`` for ASCII whitespace."""
    return F.trim(F.regexp_replace(col_(c), WS_PATTERN, " "))


def word_count(c: str | Column) -> Column:
    """Number of ``\\b\\w+\\b`` words with Unicode letters and digits; null text counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(col_(c), F.lit(WORD_PATTERN), 0)), F.lit(0))


def url_tail(c: str | Column) -> Column:
    """Last ``/``-separated part of an id or URL."""
    return F.element_at(F.split(col_(c), "/"), -1)


# HTML entities decoded by the plain-text cleaner, in decoding order;
# ``&amp;`` must come last so that ``&amp;lt;`` stays ``&lt;``.
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
]

# Elements whose text is never shown (removed before tags are stripped).
HIDDEN_BLOCKS = [r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"]


def strip_tags(c: str | Column) -> Column:
    """HTML to plain text: hidden blocks removed, tags become one space, entities
    decoded, whitespace collapsed. Regexes avoid back-references and look-arounds so
    Java and RE2 (the DuckDB oracle) agree."""
    out = col_(c)
    for pattern in HIDDEN_BLOCKS:
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse_ws(out)


def remove_elements(c: str | Column, tags: list[str]) -> Column:
    """Delete ``<tag ...>...</tag>`` blocks (non-nested) for each tag."""
    out = col_(c)
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return out


def first_element_html(c: str | Column, tag: str) -> Column:
    """Inner HTML of the first ``<tag>`` element, or "" when absent."""
    return F.regexp_extract(col_(c), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def has_element(c: str | Column, tag: str) -> Column:
    return col_(c).rlike(rf"(?i)<{tag}\b")


# ---------------------------------------------------------------- dates

def parse_iso(c: str | Column) -> Column:
    """ISO-8601 text with ``Z``, an offset, fractional seconds or no zone (read as
    UTC) to TIMESTAMP_NTZ in UTC; garbage and impossible dates give null."""
    return F.try_to_timestamp(col_(c)).cast("timestamp_ntz")   # session zone is UTC


MAX_SECONDS = 253_402_300_799   # 9999-12-31T23:59:59


def from_epoch_seconds(c: str | Column) -> Column:
    s = col_(c).try_cast("bigint")
    s = F.when(F.abs(s) <= MAX_SECONDS, s)           # beyond year 9999: null
    return F.timestamp_seconds(s).cast("timestamp_ntz")   # session zone is UTC


def from_epoch_millis_to_second(c: str | Column) -> Column:
    """Epoch milliseconds floored to the second, UTC."""
    return from_epoch_seconds(F.floor(col_(c).try_cast("bigint") / F.lit(1000)))


def add_days(ts: str | Column, days: str | Column) -> Column:
    """Timestamp plus a whole number of days (negative goes back)."""
    return col_(ts) + F.make_dt_interval(days=col_(days).cast("int"))


# ---------------------------------------------------------------- typed settings

INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def as_int(c: str | Column, default: int) -> Column:
    """``int(value)`` with fallback to ``default`` on unparsable text and on numbers out
    of range."""
    v = col_(c)
    return F.coalesce(F.when(v.rlike(INT_TEXT), F.trim(v).try_cast("int")), F.lit(default))


def as_double(c: str | Column, default: float) -> Column:
    return F.coalesce(F.trim(col_(c)).try_cast("double"), F.lit(float(default)))


def as_list(c: str | Column, sep: str = ",") -> Column:
    """Comma text to a list of trimmed, non-empty parts."""
    parts = F.transform(F.split(col_(c), F.lit(sep)), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))
