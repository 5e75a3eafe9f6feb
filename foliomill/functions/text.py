"""Text expressions with one meaning of white space, lines and word characters, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every white-space character of Unicode, as the members of a character class; the same string works in Java and RE2.
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680))) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WS = f"[{SPACES}]"


def java(pattern: str) -> str:
    """A pattern whose \\s, \\d and \\w mean Unicode classes and whose dot stops at a newline alone."""
    return "(?Ud)" + pattern.replace(r"[\s", f"[{SPACES}").replace(r"\s", WS)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def any_match(c: Column, patterns) -> Column:
    """Does the text match one of the patterns? Patterns bring their own anchors."""
    return c.rlike("(?:" + "|".join(java(p) for p in patterns) + ")")


def dedup_key(c: Column) -> Column:
    """Lower-cased without any white space."""
    return F.regexp_replace(F.lower(c), f"{WS}+", "")


def normalise(c: Column) -> Column:
    """Line ends to newlines, three and more newlines to two, lines stripped, control characters out."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.array_join(F.transform(lines(c), strip), "\n")
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def literal_contains(c: Column, words) -> Column:
    """How many of the words the text contains."""
    return sum((F.when(F.contains(c, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
