"""Digests, encodings and checksum matching as Column expressions. Null in, null out."""

from __future__ import annotations

import base64 as _b64
import functools
import hashlib
import itertools
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from quarry.functions.net import bound

#: Block sizes in bytes of the digests.
BLOCK_BYTES = {"md5": 64, "sha1": 64, "sha256": 64, "sha384": 128, "sha512": 128}
#: Digits that are read or said in one piece; longer numbers are halved.
LEAF = 48
#: Alphabets.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def as_bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def digest(data: Column, algorithm: str) -> Column:
    """Lower-case hex digest of binary data by md5, sha1, sha256, sha384, sha512 or blake2b512."""
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "sha1":
        return F.sha1(data)
    if algorithm in ("sha256", "sha384", "sha512"):
        return F.sha2(data, int(algorithm[3:]))
    if algorithm == "blake2b512":
        return _blake2b(data)
    raise ValueError(f"unknown algorithm {algorithm}")


@F.pandas_udf(StringType())
def _blake2b(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else hashlib.blake2b(b).hexdigest())


def hmac(message: Column, secret: str | bytes, algorithm: str = "sha256") -> Column:
    """HMAC in hex with one secret for all rows: two digests over constant pads, native for every digest but blake2b."""
    size = BLOCK_BYTES[algorithm]
    key = secret.encode() if isinstance(secret, str) else secret
    key = (hashlib.new(algorithm, key).digest() if len(key) > size else key).ljust(size, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, message), algorithm))), algorithm)


def base64(data: Column, urlsafe: bool = False, wrap: int | None = None) -> Column:
    """Base64 without the line breaks that the built-in adds; wrapped after `wrap` characters if given."""
    out = F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))
    if urlsafe:
        out = F.translate(out, "+/", "-_")
    return F.regexp_replace(out, f"(.{{{wrap}}})(?=.)", "$1\n") if wrap else out


def from_base64(text: Column) -> Column:
    """Bytes of base64 text in either alphabet, white space and missing padding allowed; null if it is none."""
    bare = F.regexp_replace(F.translate(F.regexp_replace(text, r"\s+", ""), "-_", "+/"), "=+$", "")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    return F.when(bare.rlike("^[A-Za-z0-9+/]*$") & (F.length(bare) % 4 != 1), F.unbase64(padded))


def to_hex(data: Column, separator: str = "", prefix: str = "") -> Column:
    """Lower-case hex, each byte after the prefix, bytes joined by the separator."""
    out = F.lower(F.hex(data))
    return out if not separator and not prefix else F.concat(F.lit(prefix), F.regexp_replace(out, "(..)(?=.)", f"$1{separator}{prefix}".replace("\\", "\\\\")))


def from_hex(text: Column) -> Column:
    r"""Bytes of hex text; \x, 0x, white space and , : . _ - between digits are skipped; null if it isn't hex."""
    bare = F.regexp_replace(text, r"(?i)\\x|0x|[\s,:._-]", "")
    return F.when(bare.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(bare))


def radix(data: Column, alphabet: str) -> Column:
    """Big-endian number of the bytes in an alphabet of 32 (by bits) or any other size (leading zero bytes kept as its first digit)."""
    @F.pandas_udf(StringType())
    def convert(values: pd.Series) -> pd.Series:
        base, signs = len(alphabet), str.maketrans(BASE32, alphabet) if len(alphabet) == 32 else {}
        # digits are said some at a time, by a table
        step = 3 if base <= 36 else 2
        said, part = ["".join(x) for x in itertools.product(alphabet, repeat=step)], base**step
        power = functools.cache(lambda k: base**k)

        def digits(n: int, count: int) -> str:
            """`count` digits of n; halves are taken apart first, so a long text takes far less than the square of its length."""
            if count <= LEAF:
                out = []
                for _ in range(-(-count // step)):
                    n, k = divmod(n, part)
                    out.append(said[k])
                return "".join(reversed(out))[-count:]
            low = LEAF << ((count - 1) // LEAF).bit_length() - 1
            high, rest = divmod(n, power(low))
            return digits(high, count - low) + digits(rest, low)

        def one(b):
            if b is None:
                return None
            if base == 32:
                return _b64.b32encode(b).decode().rstrip("=").translate(signs)
            n = int.from_bytes(b, "big")
            most = int(n.bit_length() / math.log2(base)) + 2
            return alphabet[0] * (len(b) - len(b.lstrip(b"\0"))) + digits(n, most).lstrip(alphabet[0])

        return values.map(one)

    return convert(data)


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits and -_.!~*'() as they are."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%27", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decode_component(text: Column, form: bool = False) -> Column:
    """Inverse; + stays unless it stands for a space in a form. Null if an escape is broken."""
    return F.try_url_decode(text if form else F.replace(text, F.lit("+"), F.lit("%2B")))


@F.pandas_udf(StringType())
def escape_unicode(text: pd.Series) -> pd.Series:
    r"""\uXXXX of each UTF-16 unit beyond ASCII."""
    said = functools.cache(lambda c: "".join(f"\\u{u:04x}" for u in memoryview(c.encode("utf-16-le")).cast("H")))
    return text.map(lambda t: None if t is None else re.sub("[^\x00-\x7f]", lambda m: said(m[0]), t))


def binary_text(text: Column) -> Column:
    """UTF-8 bytes as groups of eight bits."""
    pairs = F.regexp_extract_all(F.hex(as_bytes(text)), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda p: F.lpad(F.conv(p, 16, 2), 8, "0")), " ")


def matches_expected(data: Column, expected: Column) -> Column:
    """Whether any token of the expected text (split at white space, comma, semicolon; optional `algorithm=` or
    `algorithm:` before it) is the hex (any case) or base64 form of a digest of the data; null if there is no token."""
    tokens = F.filter(F.split(expected, r"[\s,;]+"), lambda t: F.length(t) >= 8)

    def hit(t: Column) -> Column:
        name, value = F.lower(F.regexp_extract(t, "^([A-Za-z0-9-]+)[=:]", 1)), F.regexp_replace(t, "^[A-Za-z0-9-]+[=:]", "")
        found = F.lit(False)
        for a in ("md5", "sha1", "sha256", "sha512"):
            d = digest(data, a)
            plain = (F.lower(value) == d) | (value == base64(F.unhex(d)))
            whole = (F.lower(t) == d) | (t == base64(F.unhex(d)))
            found = found | whole | (F.replace(name, F.lit("-"), F.lit("")).isin(a, "") & plain)
        return found

    return F.when(F.size(tokens) > 0, F.exists(tokens, hit))


def from_radix(text: Column, alphabet: str, crockford: bool = False) -> Column:
    """Bytes of a number in an alphabet, white space left out; null if it is empty or has other characters.

    32 signs are read by bits, in small letters too, without hyphens and `=`; bits that are over must be 0 and fewer than
    a sign's. crockford: I and L are 1, O is 0. Any other number of signs is one big number, in small letters
    too if the alphabet has capitals or small letters only.
    """
    by_bits, fold = len(alphabet) == 32, len(alphabet) == len(set(alphabet.lower()))

    @F.pandas_udf(BinaryType())
    def convert(values: pd.Series) -> pd.Series:
        base, place = len(alphabet), {c: k for k, c in enumerate(alphabet)}
        if fold:
            place |= {f(c): k for c, k in list(place.items()) for f in (str.upper, str.lower)}
        if by_bits and crockford:
            place |= {c: place["1"] for c in "IiLl"} | {c: place["0"] for c in "Oo"}

        skipped = str.maketrans("", "", " \t\n\f\r" + ("-=" if by_bits else ""))
        # signs as int() knows them, up to 36 of them
        plain = str.maketrans({c: BASE36[k] for c, k in place.items()}) if base <= 36 else None
        power = functools.cache(lambda k: base**k)

        def number(t: str) -> int:
            if base & (base - 1) == 0 and plain:
                return int(t, base)
            if len(t) <= LEAF:
                return int(t, base) if plain else functools.reduce(lambda n, c: n * base + place[c], t, 0)
            low = LEAF << ((len(t) - 1) // LEAF).bit_length() - 1
            return number(t[:-low]) * power(low) + number(t[-low:])

        def one(t):
            bare = None if t is None else t.translate(skipped)
            if not bare or not place.keys() >= set(bare):
                return None
            n = number(bare.translate(plain) if plain else bare)
            if by_bits:
                over = len(bare) * 5 % 8
                return None if over >= 5 or n & ((1 << over) - 1) else (n >> over).to_bytes(len(bare) * 5 // 8, "big")
            return b"\0" * (len(bare) - len(bare.lstrip(alphabet[0]))) + n.to_bytes((n.bit_length() + 7) // 8, "big")

        return values.map(one)

    return convert(text)


@F.pandas_udf(StringType())
def unescape_unicode(text: pd.Series) -> pd.Series:
    r"""Inverse of escape_unicode(): \uXXXX units become characters, everything else stays; half of a pair becomes U+FFFD."""

    def one(t):
        units = None if t is None else re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), t)
        return units if units is None or not re.search("[\ud800-\udfff]", units) else units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    return text.map(one)


def from_binary_text(bits: Column) -> Column:
    """Text of groups of eight bits split by white space or commas; null if a group is something else."""
    groups = F.filter(F.split(bits, r"[\s,]+"), lambda g: g != "")
    good = F.forall(groups, lambda g: g.rlike("^[01]{8}$"))
    return F.when(good, F.try_validate_utf8(F.unhex(F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 2, 16), 2, "0")), "")).cast("string")))


#: Characters that have a name in HTML text.
ENTITIES = {
    "&": "amp", "<": "lt", ">": "gt", '"': "quot", "'": "apos", "\u00a0": "nbsp", "\u00a1": "excl", "£": "pound", "¥": "yen", "§": "sect", "©": "copy", "®": "reg", "°": "deg", "±": "plusmn", "·": "middot",
    "×": "times", "÷": "divide", "–": "ndash", "—": "mdash", "‘": "lsquo", "’": "rsquo", "“": "ldquo", "”": "rdquo", "†": "dagger", "•": "bull", "…": "hellip", "‰": "permil", "€": "euro", "™": "trade",
}


def escape_html(text: Column, numeric: bool = False) -> Column:
    """All but printable ASCII as numbers, and, unless numeric, the characters that have a name by it."""

    @F.pandas_udf(StringType())
    def escape(texts: pd.Series) -> pd.Series:
        said = functools.cache(lambda c: f"&#{ord(c)};" if numeric or c not in ENTITIES else f"&{ENTITIES[c]};")
        signs = re.compile(r"[^\x20-\x7e]" if numeric else r"""[^\x20-\x7e]|[&<>"']""")
        return texts.map(lambda t: None if t is None else signs.sub(lambda m: said(m[0]), t))

    return escape(text)


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """Characters of named and numeric entities; what stands between & and the next ; and is neither stays. Null if a number is no character."""
    names = {f"&{name};": c for c, name in ENTITIES.items()}
    number = re.compile(r"&#(?:[xX]0*([0-9A-Fa-f]+)|0*([0-9]+));")

    @functools.lru_cache(10_000)
    def said(t):
        found = number.fullmatch(t)
        if not found:
            return names.get(t, t)
        digits = found[1] or found[2]
        code = 0 if len(digits) > 7 else int(digits, 16 if found[1] else 10)
        return chr(code) if 0 < code < 0xD800 or 0xDFFF < code <= 0x10FFFF else None

    def one(t):
        if t is None or "&" not in t:
            return t
        # what stands between two hits is at an even place
        parts = re.split("(&[^;]*;)", t)
        parts[1::2] = map(said, parts[1::2])
        return None if None in parts else "".join(parts)

    return text.map(one)


def jwt_parts(token: Column) -> Column:
    """header and claims (JSON text), algorithm, subject, expiry and start of a compact token; null unless it has three base64url parts with JSON in the first two."""
    part = F.split(F.regexp_replace(token, r"\s+", ""), r"\.", -1)
    text = lambda k: F.try_validate_utf8(from_base64(F.get(part, k)).cast("string"))
    header, claims = text(0), text(1)
    good = (F.size(part) == 3) & F.schema_of_variant(F.try_parse_json(header)).startswith("OBJECT") & F.schema_of_variant(F.try_parse_json(claims)).startswith("OBJECT")
    number = lambda k: F.get_json_object(claims, f"$.{k}").try_cast("long")
    return F.when(good, F.struct(header.alias("header"), claims.alias("claims"), F.get_json_object(header, "$.alg").alias("alg"), F.get_json_object(claims, "$.sub").alias("sub"), number("exp").alias("exp"), number("nbf").alias("nbf")))


def jwt_status(token: Column, secret: str, now: Column, leeway: int = 0) -> Column:
    """valid, expired, not-yet-valid or invalid-signature of a token signed by HS256, HS384 or HS512; null for anything else. Time claims count before the signature does."""
    held = max(0, min(3600, leeway))

    def status(x: Column) -> Column:
        parts, said = x["parts"], F.lower(x["parts"]["alg"])
        signed, mac = F.substring_index(x["compact"], ".", 2), F.lower(F.hex(from_base64(F.substring_index(x["compact"], ".", -1))))
        right = F.lit(False)
        for a in ("256", "384", "512"):
            right = right | ((said == "hs" + a) & (hmac(as_bytes(signed), secret, "sha" + a) == mac))
        late, early = F.coalesce(now - held > parts["exp"], F.lit(False)), F.coalesce(now + held < parts["nbf"], F.lit(False))
        return F.when(said.isin("hs256", "hs384", "hs512"), F.when(late, "expired").when(early, "not-yet-valid").when(right, "valid").otherwise("invalid-signature"))

    return bound(F.struct(jwt_parts(token).alias("parts"), F.regexp_replace(token, r"\s+", "").alias("compact")), status)
