"""HMAC with a key a row, and one-time codes, as Column expressions. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.encoding import BASE32, BLOCK_BYTES, digest
from quarry.functions.net import bound

#: Digits of base 32 as conv() knows them.
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def hmac_by_key(message: Column, key: Column, algorithm: str = "sha256") -> Column:
    """HMAC in hex of binary data with a binary key of each row: the key, filled up to a block, is changed a byte at a time into the two pads."""
    size = BLOCK_BYTES[algorithm]
    short = F.when(F.octet_length(key) > size, F.unhex(digest(key, algorithm))).otherwise(key)
    filled = F.decode(F.unhex(F.rpad(F.hex(short), 2 * size, "0")), "ISO-8859-1")

    def pad(k: Column, byte: int) -> Column:
        # translate() leaves out what becomes the character 0, so that one goes by a sign that no byte stands for
        after = "".join(chr(b ^ byte) for b in range(256)).replace("\0", "\u0100")
        return F.encode(F.replace(F.translate(k, "".join(map(chr, range(256))), after), F.lit("\u0100"), F.lit("\0")), "ISO-8859-1")

    return bound(filled, lambda k: digest(F.concat(pad(k, 0x5C), F.unhex(digest(F.concat(pad(k, 0x36), message), algorithm))), algorithm))


def from_base32(text: Column) -> Column:
    """Bytes of a base 32 secret in either case, white space, hyphens, _ and = left out; bits that are over are dropped.

    Null if it is empty, has other characters, or five or more bits are over.
    """
    bare = F.upper(F.regexp_replace(text, r"[\s_=-]", ""))

    def read(s: Column) -> Column:
        n = F.length(s)
        groups = F.regexp_extract_all(F.rpad(F.translate(s, BASE32, CONV32), (F.ceil(n / 8) * 8).cast("int"), "0"), F.lit("(.{8})"), F.lit(1))
        digits = F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 32, 16), 10, "0")), "")
        return F.when(s.rlike("^[A-Z2-7]+$") & (n * 5 % 8 < 5), F.unhex(F.substring(digits, F.lit(1), (F.floor(n * 5 / 8) * 2).cast("int"))))

    return bound(bare, read)


def hotp(key: Column, counter: Column, digits: int = 6, algorithm: str = "sha1") -> Column:
    """The code of a counter: 31 bits of the HMAC from where its last four bits say, their last `digits` decimal digits. algorithm: sha1, sha256, sha384 or sha512."""
    if algorithm == "md5":
        raise ValueError("a code needs at least 20 bytes of digest")

    def code(mac: Column) -> Column:
        at = F.conv(F.right(mac, F.lit(1)), 16, 10).cast("int") * 2 + 1
        n = F.conv(F.substring(mac, at, F.lit(8)), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
        return F.lpad((n % 10**digits).cast("string"), digits, "0")

    return bound(hmac_by_key(F.unhex(F.lpad(F.hex(counter.cast("long")), 16, "0")), key, algorithm), code)


def step_of(at_second: Column, period: int) -> Column:
    return F.floor(at_second / period).cast("long")


def totp(secret: Column, at_second: Column, digits: int = 6, period: int = 30, algorithm: str = "sha1") -> Column:
    """Time-based code of a base 32 secret at a Unix time; null for a secret that is none."""
    return hotp(from_base32(secret), step_of(at_second, period), digits, algorithm)


def totp_check(code: Column, secret: Column, at_second: Column, window: int = 1, digits: int = 6, period: int = 30, algorithm: str = "sha1") -> Column:
    """valid, hits (steps from now, earliest first, at which the code is right; steps before 0 are none) and counter.

    White space, hyphens and _ in a code are left out; a longer one counts by its last digits, a shorter one gets zeros before it.
    Null if the code is empty or has other characters than digits, or the secret is none.
    """
    bare = F.regexp_replace(code, r"[ \t\r\n_-]", "")
    said = F.lpad(F.right(bare, F.lit(digits)), digits, "0")

    def check(x: Column) -> Column:
        steps = F.sequence(F.lit(-window), F.lit(window))
        hits = F.filter(steps, lambda o: (x["step"] + o >= 0) & (hotp(x["key"], x["step"] + o, digits, algorithm) == x["said"]))
        return F.when(x["key"].isNotNull() & x["step"].isNotNull() & x["said"].isNotNull(), bound(hits, lambda h: F.struct((F.size(h) > 0).alias("valid"), h.alias("hits"), x["step"].alias("counter"))))

    return bound(F.struct(from_base32(secret).alias("key"), step_of(at_second, period).alias("step"), F.when(bare.rlike("^[0-9]+$"), said).alias("said")), check)
