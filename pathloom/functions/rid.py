"""Row identifiers: a 64-bit number and a zero bit in base 32, grouped by four from the right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN, CROCKFORD = "IJKLMNOPQRSTUV", "JKMNPQRSTVWXYZ"


def encode(number: Column | str) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    # the sixty-fifth bit is beyond conv's range: the top symbol is made apart
    low = F.lpad(F.conv(F.shiftleft(number.bitwiseAND(F.lit((1 << 59) - 1)), 1).cast("string"), 10, 32), 12, "0")
    top = F.conv(F.shiftrightunsigned(number, 59).cast("string"), 10, 32)
    digits = F.translate(F.concat(top, low), PLAIN, CROCKFORD)
    grouped = F.reverse(F.regexp_replace(F.reverse(digits), "(.{4})(?=.)", "$1-"))
    short = F.regexp_replace(grouped, "^[0-]+", "")
    return F.when(short == "", "0").otherwise(short)


def decode(text: Column) -> Column:
    """Null where the text isn't an identifier. O stands for 0, I and L for 1, in either case, hyphens anywhere."""
    raw = F.translate(F.upper(text), "OIL-", "011")
    good = raw.rlike("^[0-9A-HJKMNP-TV-Z]{1,13}$")
    wide = F.lpad(F.translate(raw, CROCKFORD, PLAIN), 13, "0")
    top = F.conv(F.substring(wide, 1, 1), 32, 10).cast("bigint")
    low = F.shiftrightunsigned(F.conv(F.substring(wide, 2, 12), 32, 10).cast("bigint"), 1)
    return F.when(good, F.shiftleft(top, 59).bitwiseOR(low))


def encode_time(time: Column) -> Column:
    return encode(F.unix_micros(time))


def decode_time(text: Column) -> Column:
    return F.timestamp_micros(decode(text))
