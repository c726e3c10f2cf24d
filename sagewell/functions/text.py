"""Text expressions on columns. Everything here stays inside Catalyst."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as one character class (Java and RE2 spell it the same way).
BLANK = (
    r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same characters for Java: one range test settles a letter, before the parts of the class are tried one by one.
QUICK_BLANK = r"[\x{0}-\x{20}\x{7f}-\x{10ffff}&&" + BLANK + "]"


@lru_cache(maxsize=1)
def latin_fold() -> tuple[str, str]:
    """(accented letters, plain letters): every lower-case letter whose NFD base is a-z or 0-9."""
    accented, plain = ["đ"], ["d"]
    for code in range(0x80, 0x3000):
        char = chr(code)
        base = unicodedata.normalize("NFD", char)
        if char == char.lower() and len(base) > 1 and base[0] in "abcdefghijklmnopqrstuvwxyz0123456789":
            if all(unicodedata.category(mark) == "Mn" for mark in base[1:]):
                accented.append(char)
                plain.append(base[0])
    return "".join(accented), "".join(plain)


def collapse(text: Column) -> Column:
    """White-space runs become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, QUICK_BLANK + "+", " "))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends only."""
    return F.regexp_replace(text, f"^{BLANK}+|{QUICK_BLANK}++$", "")


def normalized(text: Column) -> Column:
    """Lower-case, accent-free ``[a-z0-9]+`` words joined by single blanks."""
    accented, plain = latin_fold()

    def fold(lowered: Column) -> Column:
        folded = F.regexp_replace(F.translate(lowered, accented, plain), r"\p{Mn}", "")
        # Pure ASCII text has nothing to fold; ``translate`` walks a dictionary for every character.
        ready = F.when(F.octet_length(lowered) == F.length(lowered), lowered).otherwise(folded)
        return F.trim(F.regexp_replace(ready, "[^a-z0-9]+", " "))

    return let(F.lower(text), fold)


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def search_tokens(normalized_text: Column, least_chars: int = 2) -> Column:
    """Distinct words of at least ``least_chars`` characters of an already normalised text."""
    return F.array_distinct(F.filter(F.split(normalized_text, " "), lambda w: F.length(w) >= least_chars))


@lru_cache(maxsize=1)
def _named_characters() -> dict[str, str]:
    """The character of every named entity of HTML 4, and of ``apos``."""
    return {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def decode_entities(text: Column) -> Column:
    """Named and numeric character references become characters, each once; unknown ones stay as they are."""

    def character(reference: Column) -> Column:
        names = F.create_map(*[F.lit(v) for pair in sorted(_named_characters().items()) for v in pair])
        number = F.when(
            reference.rlike("^#[0-9]"), F.conv(F.substring(reference, 2, 12), 10, 16)
        ).otherwise(F.conv(F.substring(reference, 3, 12), 16, 16))
        valid = (F.length(number) <= 6) & ~number.rlike("^(0|D[89A-F]..|(?:1[1-9A-F]|[2-9A-F].).{4})$")
        sign = F.decode(F.unhex(F.lpad(F.when(valid, number).otherwise("FFFD"), 8, "0")), "UTF-32")
        return F.when(reference.startswith("#"), sign).otherwise(F.try_element_at(names, reference))

    def part(after: Column) -> Column:
        reference = F.regexp_extract(after, r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 1)
        return let(reference, lambda ref: let(
            F.when(ref != "", character(ref)),
            lambda sign: F.when(sign.isNull(), F.concat(F.lit("&"), after)).otherwise(
                F.concat(sign, F.substring(after, F.length(ref) + 2, F.length(after))))))

    def decode(bound: Column) -> Column:
        parts = F.split(bound, "&")
        rest = F.transform(F.slice(parts, 2, F.size(parts)), part)
        return F.when(
            bound.contains("&"), F.concat(F.substring_index(bound, "&", 1), F.array_join(rest, ""))
        ).otherwise(bound)

    return let(text, decode)


def contains_any(text: Column, keywords) -> Column:
    """True when any keyword is a substring; keywords are a small fixed vocabulary."""
    found = F.lit(False)
    for keyword in keywords:
        found = found | text.contains(keyword)
    return found


def first_rule(text: Column, rules, default: str | None) -> Column:
    """Name of the first rule, in order, with a keyword inside ``text``.

    ``rules`` is an ordered list of (name, keywords). It is compiled into one projection, so a
    rule table costs neither a join nor a shuffle.
    """

    def chain(bound: Column) -> Column:
        named = F.lit(default)
        for name, keywords in reversed(list(rules)):
            named = F.when(contains_any(bound, keywords), name).otherwise(named)
        return named

    # Bound once: a condition inside CASE WHEN is not shared by the code generator.
    return let(text, chain)


def matching_rules(text: Column, rules) -> Column:
    """Array of the names of all rules hit, in rule order."""

    def names(bound: Column) -> Column:
        flags = [F.when(contains_any(bound, keywords), F.lit(name)) for name, keywords in rules]
        return F.filter(F.array(*flags), lambda name: name.isNotNull())

    return let(text, names)


def compact(text: Column, limit: int) -> Column:
    """Collapse blanks and cut: a longer text keeps ``limit - 1`` characters plus three dots."""
    flat = collapse(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def content_hash(canonical_url: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", canonical_url, content), 256)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body`` inside a higher-order expression."""
    return F.element_at(F.transform(F.array(value), body), 1)
