"""Column functions on text: hashes, simhash, tokens, JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Features whose hashes are counted at once.
COUNTED = 65_535


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def html_text(html: Column) -> Column:
    """Without tags, trimmed."""
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def features(text: Column) -> Column:
    """The pairs of neighbouring characters of the stripped text, or the whole of it below two characters."""
    s = strip(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(F.length(s) < 2, F.array(s)).otherwise(pairs)


def simhash(text: Column) -> Column:
    """The 64-bit simhash of a text, signed: bit b is set if more than half of the features' hashes (the last eight
    bytes of MD5) have it."""
    hashes = F.transform(features(text), lambda f: F.conv(F.substring(F.md5(f.cast("binary")), 17, 16), 16, -10).cast("bigint"))

    # four counters of 16 bits in each of 16 numbers: one addition counts four bits of a hash
    lanes = F.lit(0x0001000100010001)
    right = lambda x, n: F.call_function("shiftrightunsigned", x, F.lit(n))

    def counted(h: Column) -> Column:
        start = F.struct(*[F.lit(0).cast("bigint").alias(f"c{k}") for k in range(16)])
        add = lambda acc, x: F.struct(*[(acc[f"c{k}"] + right(x, k).bitwiseAND(lanes)).alias(f"c{k}") for k in range(16)])
        return F.aggregate(h, start, add)

    def fold(h: Column) -> Column:
        # no counter holds more features than this; more are counted in parts
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / COUNTED)), lambda i: counted(F.slice(h, (i * COUNTED + 1).cast("int"), COUNTED)))
        ones = lambda p, b: F.aggregate(p, F.lit(0), lambda n, c: n + right(c[f"c{b % 16}"], b // 16 * 16).bitwiseAND(F.lit(0xFFFF)).cast("int"))
        bits = lambda p: [F.when(2 * ones(p, b) > F.size(h), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
        return F.transform(F.array(parts), lambda p: reduce(lambda x, y: x.bitwiseOR(y), [b.cast("bigint") for b in bits(p)]))[0]

    return F.transform(F.array(hashes), fold)[0]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def best_json(text: Column, schema: str) -> Column:
    """The first object that parses: the whole text, a fenced block, or what lies between the first { and the last }."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parse = lambda c: F.when(strip(c).startswith("{"), F.from_json(c, schema))
    good = lambda c: F.when(F.try_parse_json(c).isNotNull(), parse(c))
    return F.coalesce(good(text), good(fenced), good(inner))


def path_segment(value: Column, most: int) -> Column:
    """Percent-encoded text for a path, so many characters at most."""
    return F.substring(F.regexp_replace(F.url_encode(value), r"\+", "%20"), 1, most)
