"""Text functions as column expressions; all of them stay inside of generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space inside of a line and in all, and words that are no content.
LINE_SPACE = r"[ \t\x0b\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE = LINE_SPACE[:-1] + r"\n]"
NO_SPACE = "[^" + SPACE[1:]
STOP_WORDS = "the a an and or of to in on for is are be with as at by it this that from you your can will if not but has have was were we i".split()
ERROR_LINE = "(?i)(error|failed|failure|cannot|denied|timeout|timed out|refused|unavailable|crashloopbackoff|imagepullbackoff|oomkilled|not found|exception)"
NO_TERM = r"(?i)^(the|a|an|this|that|it|they|you|we|note|example|step)\b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_text(c: Column) -> Column:
    """One kind of line end, no control characters, single spaces, at most one blank line."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0e-\x1f\x7f]", " ")
    c = F.regexp_replace(c, r"[ \t\x0b\f\r]+", " ")
    c = F.regexp_replace(c, f"{LINE_SPACE}*\n{LINE_SPACE}*", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    """Words, paths, flags and versions in lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_.\-/]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def normalized(c: Column) -> Column:
    """For equality tests: lower case, letters and digits only."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def short_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts; no part may be null."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{NO_SPACE}+"), F.lit(0))


def estimated_tokens(c: Column) -> Column:
    """The larger of a quarter of the characters and 1.3 times the words; 0 for no text."""
    most = F.greatest(F.length(c) / 4, F.size(words(c)) * F.lit(1.3))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(most).cast("int")))


def truncated(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space if that keeps more than six tenths."""
    text = strip(c)
    cut = F.substring(text, 1, limit)
    back = F.instr(F.reverse(cut), " ")
    at = F.when(back > 0, F.length(cut) - back).otherwise(-1)
    short = F.when(at > limit * 0.6, cut.substr(F.lit(1), at)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(short, F.lit(" …")))


def term_key(c: Column) -> Column:
    """Key under which terms are one: case, punctuation and a plural s do not count."""
    key = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    plural = (F.length(key) > 3) & key.endswith("s") & ~key.endswith("ss")
    return F.when(plural, key.substr(F.lit(1), F.length(key) - 1)).otherwise(key)


def useful_term(c: Column) -> Column:
    size = F.length(c)
    good = (size >= 2) & (size <= 60) & ~c.rlike(NO_TERM) & (F.size(words(c)) <= 6) & c.rlike(r"\p{L}")
    return F.coalesce(good, F.lit(False))


def norm_tokens(c: Column) -> Column:
    """Distinct tokens without the punctuation of sentences."""
    bare = F.transform(tokens(c), lambda t: F.regexp_replace(t, r"^[.,;:!?()]+|[.,;:!?()]+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def count_of(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def source_label(tags: Column, url: Column) -> Column:
    """The first ``source:`` tag, else human or input for such urls, else unknown."""
    tag = F.get(F.filter(tags, lambda t: t.startswith("source:")), 0)
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), "^(human|input)://", 1)
    return F.coalesce(F.regexp_replace(tag, "^source:", ""), F.nullif(scheme, F.lit("")), F.lit("unknown"))
