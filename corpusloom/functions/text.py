"""Text helpers as Column expressions; white space and lines are meant as Python means them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character of white space (Unicode, and the four information separators).
SPACE = r"[\s\x1C-\x1F]"
#: All such characters.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
MODEL_NAMES = {"nomic-embed-text": "nomic-ai/nomic-embed-text-v1.5"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The parts between runs of white space."""
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda line: line != "")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def norm_id(text: Column) -> Column:
    """Lower case; blanks and slashes become underscores; other characters than a-z, 0-9, _ . - go; nothing left: ``unknown``."""
    kept = F.regexp_replace(F.translate(F.lower(text), " /\\", "___"), r"[^a-z0-9_.\-]", "")
    return F.coalesce(blank_to_null(kept), F.lit("unknown"))


def chunk_id(category: Column, document: Column, index: Column) -> Column:
    return F.concat_ws("/", norm_id(category), norm_id(document), index.cast("string"))


def norm_category(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), rf"(?U)(?:{SPACE}|-)+", "_")


def truncate(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last three dots where something was cut."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(rstrip(F.substring(text, 1, size - 3)), F.lit("...")))


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"[^a-zA-Z0-9_\-]", "_")


def case_id(url: Column, text: Column) -> Column:
    """The last part of the URL's path that isn't empty, as a file name, else the MD5 of the text."""
    parts = F.filter(F.split(strip(F.coalesce(url, F.lit(""))), "/"), lambda p: p != "")
    return F.coalesce(safe_filename(F.try_element_at(parts, F.lit(-1))), F.md5(text.cast("binary")))


def category_of(identifier: Column) -> Column:
    """What stands before the first slash; null without one."""
    return F.when(F.instr(identifier, "/") > 0, F.split_part(identifier, F.lit("/"), F.lit(1)))


def first_nonempty(*columns: Column) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))


def excerpt(original: Column, text: Column, size: int = 1500) -> Column:
    """The original text (else the text), trimmed, cut to ``size`` characters with an ellipsis."""
    whole = strip(F.coalesce(blank_to_null(original), text, F.lit("")))
    return F.when(F.length(whole) > size, F.concat(F.substring(whole, 1, size), F.lit("…"))).otherwise(whole)


def namespace(category: str, model: str, with_summary: bool) -> str:
    return f"{category}_{model}_{'sac' if with_summary else 'no_sac'}"


def model_name(short: str) -> str:
    """The registered name of a model, or the name itself."""
    return MODEL_NAMES.get(short, short)


def tokens(text: Column) -> Column:
    """Lower-case words, the tokens of the sparse index."""
    return words(F.lower(text))


def whole_match(text: Column, pattern: str) -> Column:
    """The first match of ``pattern``, '' without one."""
    return F.regexp_extract(text, pattern, 0)
