"""Scalar functions of the engine as column expressions: parsing, exact arithmetic, globs, file names, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NEVER

#: Characters that a glob takes literally although a regular expression would not.
GLOB_LITERAL = ".()+|^$@%\\"


def parse_long(text: Column) -> Column:
    """A 64-bit integer of an optional sign and digits, else null; no blanks (the cast alone would trim)."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def add_exact(a: Column, b: Column) -> Column:
    """The sum, or null on overflow."""
    return F.try_add(a, b)


def ttl_ms(found: Column, expires_at_ms: Column, now_ms: int | Column) -> Column:
    """-2 if absent, -1 without expiry, else what is left, 0 at least."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return F.when(~found, F.lit(-2)).when(expires_at_ms == NEVER, F.lit(-1)).otherwise(F.greatest(F.lit(0), expires_at_ms - now)).cast("bigint")


def ttl_seconds(ms: Column) -> Column:
    """Whole seconds, rounded down; -1 and -2 stay."""
    return F.when(ms < 0, ms).otherwise(F.floor(ms / 1000)).cast("bigint")


def glob_regex(pattern: Column) -> Column:
    r"""The regular expression of a glob: ``*`` any text, ``?`` one character; brackets and braces pass through.

    A newline is no "any character"; the match is of the whole text (``\A...\z``, as rlike only searches).
    """
    return F.concat(
        F.lit(r"\A"),
        F.array_join(
            F.transform(
                F.filter(F.split(pattern, ""), lambda c: c != ""),
                lambda c: F.when(c == "*", F.lit(".*")).when(c == "?", F.lit(".")).when(F.instr(F.lit(GLOB_LITERAL), c) > 0, F.concat(F.lit("\\"), c)).otherwise(c),
            ),
            "",
        ),
        F.lit(r"\z"),
    )


def glob_match(pattern: Column, text: Column) -> Column:
    return F.rlike(text, glob_regex(pattern))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 units: one more for each code point beyond the basic plane (four bytes in UTF-8)."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


def entry_bytes(key: Column, value: Column) -> Column:
    """Accounted size of a buffered entry: two bytes a UTF-16 unit of key and value, and eight."""
    return (2 * utf16_units(key) + F.coalesce(2 * utf16_units(value), F.lit(0)) + 8).cast("bigint")


#: Fixed value: names of sorted-run files.
RUN_NAME = r"\A(?:sst-|L([0-9]+)-)([0-9]+)\.db\z"


def file_sequence(name: Column) -> Column:
    """The sequence number in a run's file name, -1 if it is none."""
    return F.coalesce(F.when(name.rlike(RUN_NAME), F.regexp_extract(name, RUN_NAME, 2).try_cast("bigint")), F.lit(-1)).cast("bigint")


def file_level(name: Column) -> Column:
    """The level in a run's file name; 0 for names without one, -1 if it is none."""
    level = F.regexp_extract(name, RUN_NAME, 1)
    return F.coalesce(F.when(name.rlike(RUN_NAME), F.when(level == "", F.lit(0)).otherwise(level.try_cast("bigint"))), F.lit(-1)).cast("bigint")


def file_name(level: Column, sequence: Column) -> Column:
    return F.format_string("L%d-%06d.db", level, sequence)


def snapshot_name(epoch_ms: Column) -> Column:
    return F.format_string("snapshot-%013d.db", epoch_ms)


def bloom_bits(n: Column, rate: float = 0.01) -> Column:
    """Bits of a Bloom filter for n keys at a false-positive rate."""
    return F.ceil(-n * F.log(F.lit(rate)) / F.pow(F.log(F.lit(2.0)), F.lit(2.0))).cast("bigint")


def bloom_hashes(n: Column, bits: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(bits / n * F.log(F.lit(2.0)))).cast("bigint")
