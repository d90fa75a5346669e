"""Text functions as Column expressions: tokens, normalised code, hashes, similarity.

Patterns carry the flags that make Java's regular expressions read Unicode text as the data
contract does: ``(?U)`` for word characters and blanks, ``(?d)`` where only a line feed ends
a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers and numbers of code.
TOKEN = r"([a-z_$][a-z0-9_$]*|\p{Nd}+)"
#: The same over both cases; differs only for letters whose lower case is longer.
TOKEN_ANY_CASE = r"([A-Za-z_$][A-Za-z0-9_$]*|\p{Nd}+)"
#: What ``(?U)\s`` matches.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Words that don't count for coverage.
STOP_WORDS = ["the", "a", "an", "and", "or", "to", "of", "in", "for", "with", "that", "this", "must", "should"]


def tokens(text: Column) -> Column:
    """Distinct tokens of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)))


def tokens_any_case(text: Column) -> Column:
    """Distinct tokens as the first record version cut them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_ANY_CASE), F.lit(1)))


def content_tokens(text: Column) -> Column:
    """Distinct tokens but for stop words."""
    return F.array_except(tokens(text), F.array(*map(F.lit, STOP_WORDS)))


def words(text: Column) -> Column:
    """Words, with inner apostrophes and hyphens."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b[\w'-]+\b"), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without any blanks at the ends; ``trim`` only knows spaces, and a pattern would be tried at each character."""
    return F.btrim(text, F.lit(BLANKS))


def uncommented(text: Column) -> Column:
    """Code without comments (also what follows // in strings); its tokens are those of ``normalize_code``."""
    return F.when(text.contains("//") | text.contains("/*"), F.regexp_replace(text, r"(?d)//.*|/\*[\s\S]*?\*/", "")).otherwise(text)


def normalize_code(text: Column) -> Column:
    """Code without comments, blanks squeezed."""
    return squeeze(uncommented(text))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def stripped_digest(text: Column) -> Column:
    return digest(strip(text))


def portable_digest(text: Column) -> Column:
    """Digest that doesn't depend on the kind of line ends."""
    return digest(strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))))


def stable_key(seed: str, value: Column) -> Column:
    """Reproducible order key: the digest of ``seed:value``."""
    return digest(F.concat(F.lit(f"{seed}:"), value.cast("string")))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """|a and b| / |a or b| of arrays without repeats; ``both_empty`` where neither has any."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(both_empty)).otherwise(shared / union)


def coverage(parts: Column, text: Column, held: Column | None = None) -> Column:
    """Share of the parts' content tokens that the text has; 0 without any. ``held`` are the text's tokens, if at hand."""
    expected = content_tokens(F.array_join(parts, " "))
    held = tokens(text) if held is None else held
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, held)) / F.size(expected)).otherwise(0.0)


def round_half_even(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)


def slug(text: Column) -> Column:
    """Lower-cased, runs of other characters than a-z and 0-9 as a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def to_camel(text: Column) -> Column:
    """kebab-case as camelCase: a hyphen before a-z goes and the letter is raised."""
    parts = F.split(text, "-(?=[a-z])")
    raised = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(raised, ""))


def tail(text: Column, count: int) -> Column:
    return F.right(text, F.lit(count))


def head(text: Column, count: int) -> Column:
    return F.substring(text, 1, count)


def redact(text: Column, secret: Column, count: int = 500) -> Column:
    """Without the secret, blanks squeezed to spaces, cut."""
    return head(F.regexp_replace(F.replace(text, secret, F.lit("[REDACTED]")), r"(?U)\s+", " "), count)


def backoff_seconds(attempt: Column, most: int = 8) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(most)))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1 and inclusive; null if the text has fewer."""
    lines = F.split(F.regexp_replace(text, "\n\\z", ""), "\n")
    inside = (start >= 1) & (end >= start) & (end <= F.size(lines))
    return F.when(inside, F.array_join(F.slice(lines, start.cast("int"), (end - start + 1).cast("int")), "\n"))


def by_locale(text: Column) -> Column:
    """Text to sort by as people do: letters before their case and accents (ICU's root order)."""
    return F.collate(text, "UNICODE")
