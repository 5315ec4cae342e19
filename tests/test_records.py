import base64
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import codes, matches
from quarry.operators import archive


@pytest.mark.parametrize("algorithm", ["md5", "sha1", "sha256", "sha384", "sha512"])
def test_hmac_by_key(spark, algorithm):
    r = random.Random(3)
    rows = [(r.randbytes(n), r.randbytes(m)) for n, m in [(0, 0), (1, 5), (63, 9), (64, 0), (65, 7), (127, 3), (128, 1), (129, 200), (1000, 3000)]] + [(b"6\\6\\" * 16, b"x")]
    df = spark.createDataFrame([*rows, (None, b"a"), (b"a", None)], "key binary, message binary")
    got = [r["mac"] for r in df.select(codes.hmac_by_key(F.col("message"), F.col("key"), algorithm).alias("mac")).collect()]
    assert got == [hmac.new(k, m, algorithm).hexdigest() for k, m in rows] + [None, None]


def test_from_base32(spark):
    r = random.Random(4)
    blobs = [r.randbytes(n) for n in range(1, 40)]
    texts = [base64.b32encode(b).decode() for b in blobs]
    bad = ["", " - ", "A", "AAA", "AAAAAA", "1AAA", "ÄÄ", None]
    df = spark.createDataFrame([(t,) for t in [*texts, "ge zd-gn_bv", *bad]], "t string")
    got = [r["x"] for r in df.select(codes.from_base32(F.col("t")).alias("x")).collect()]
    assert [None if x is None else bytes(x) for x in got] == [*blobs, b"12345"[:5], *[None] * len(bad)]


#: Codes of the standard's secret, by time and algorithm.
SECRETS = {"sha1": b"12345678901234567890", "sha256": b"12345678901234567890123456789012", "sha512": b"1234567890123456789012345678901234567890123456789012345678901234"}
VECTORS = [
    (59, "sha1", "94287082"), (59, "sha256", "46119246"), (59, "sha512", "90693936"), (1111111109, "sha1", "07081804"), (1111111109, "sha256", "68084774"), (1111111109, "sha512", "25091201"),
    (20000000000, "sha1", "65353130"), (20000000000, "sha256", "77737706"), (20000000000, "sha512", "47863826"),
]


def test_codes_of_the_standard(spark):
    one = spark.range(1)
    got = one.select(*[codes.totp(F.lit(base64.b32encode(SECRETS[a]).decode()), F.lit(t), 8, 30, a).alias(f"c{i}") for i, (t, a, _) in enumerate(VECTORS)]).first()
    assert list(got) == [c for *_, c in VECTORS]
    counters = spark.range(10).select(codes.hotp(F.lit(SECRETS["sha1"]), F.col("id")).alias("c")).collect()
    assert [r["c"] for r in counters] == ["755224", "287082", "359152", "969429", "338314", "254676", "287922", "162583", "399871", "520489"]
    assert spark.range(1).select(codes.hotp(F.lit(SECRETS["sha1"]), F.lit(1), 10)).first()[0] == "1094287082"


def test_check_of_a_code(spark):
    secret = base64.b32encode(SECRETS["sha1"]).decode()
    cases = [("287 082", 59, [0]), ("287-082", 89, [-1]), ("287082", 29, [1]), ("287082", 119, []), ("99287082", 59, [0]), ("755224", 0, [0]), ("755224", 31, [-1]), ("x", 59, None), ("", 59, None), (None, 59, None), ("287082", None, None)]
    df = spark.createDataFrame([(c, t) for c, t, _ in cases], "code string, at long")
    got = [r["x"] for r in df.select(codes.totp_check(F.col("code"), F.lit(secret), F.col("at")).alias("x")).collect()]
    assert [x and x["hits"] for x in got] == [h for *_, h in cases]
    assert [x and x["valid"] for x in got] == [None if h is None else bool(h) for *_, h in cases]
    assert df.select(codes.totp_check(F.col("code"), F.lit("0"), F.col("at")).alias("x")).where("x is not null").count() == 0


TEXTS = ["", "a", "xa1b22", "no", "𝔘a1 é a", "aXbXc", "1a2b3c", "\n1\n", None, "aaa"]
PATTERNS = ["a", "([a-z])([0-9]+)?", "x*", "(?<l>[a-z])|(?<d>[0-9])", "$", "^", "(?=a)", r"\((\d)\)|[(\]](b)", "X|(?:b)"]


def test_group_names():
    assert matches.group_names(r"(a)(?:b)(?<n>c(d))\(e[(](?=f)(?<!g)\Q(\E(h)") == [None, "n", None, None]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_match_table(spark, pattern):
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(TEXTS)], "id long, text string, n int")
    got = sorted((r["id"], r["n"], r["start"], r["stop"], r["value"], tuple(r["groups"]), tuple(sorted(r["named"].items()))) for r in matches.match_table(df, ["id"], "text", pattern, "m", utf16=False).collect())
    want = []
    for i, t in enumerate(TEXTS):
        for n, m in enumerate(re.finditer(re.sub(r"\(\?<(?=[a-z])", "(?P<", pattern), t or "", re.MULTILINE) if t is not None else [], 1):
            want.append((i, n, m.start(), m.end(), m[0], tuple(g or "" for g in m.groups()), tuple(sorted((k, v or "") for k, v in m.groupdict().items()))))
    if pattern in ("$", "^"):  # a line break at the end is seen in another way there
        got, want = ([r for r in x if TEXTS[r[0]] != "\n1\n"] for x in (got, want))
        if pattern == "^":
            got, want = ([r for r in x if TEXTS[r[0]] != ""] for x in (got, want))
    assert got == want


def test_places_in_utf16(spark):
    df = spark.createDataFrame([("𝔘a𝔘𝔘a",)], "text string").withColumn("k", F.lit(None).cast("int"))
    assert [(r["start"], r["stop"]) for r in matches.match_table(df, ["k"], "text", "a|𝔘a").orderBy("n").collect()] == [(0, 3), (5, 8)]
    assert matches.match_table(df.limit(0), ["k"], "text", "a").count() == 0
    with pytest.raises(ValueError, match="no pattern"):
        matches.match_table(df, ["k"], "text", "")


def test_rewritten(spark):
    cases = [
        ("a1b2", "([a-z])([0-9])", "[$2$1|$`|$']", "g", "[1a||b2][2b|a1|]"), ("a1b2", "[a-z]", "<$'>", "", "<1b2>1b2"), ("ab", "x*", "-", "g", "-a-b-"), ("a-b", "-", "$$$0$1$&$", "g", "a$$0$1-$b"),
        ("ab", "(?<q>a)", "$<q>$<r>$11$2", "g", "aa1$2b"), ("ab", "(a)", "$<q>", "g", "$<q>b"), ("", "a", "b", "g", ""), (None, "a", "b", "g", None), ("AbA", "a", "$`.", "gi", ".bAb."), ("x", "a", "b", "g", "x"), ("𝔘a", "x*", "-", "g", "-𝔘-a-"),
    ]
    for text, pattern, replacement, flags, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(matches.regex_rewritten(F.col("t"), pattern, replacement, flags)).first()[0] == want, (text, pattern, replacement)


def plain_free(names, existing):
    """Names one after the other: the first asker of a free name has it, a later one the least number that is nobody's."""
    existing, asked, given, out = set(existing), {n for n in names if n is not None}, set(), []
    for n in names:
        said = n
        if n is not None and (n in existing or n in given):
            cut = re.fullmatch(r"(?s)(.*[^/])(\.[^./]*)", n)
            stem, extension = cut.groups() if cut else (n, "")
            k = 2
            while (said := f"{stem} ({k}){extension}") in existing | asked | given:
                k += 1
        given.add(said)
        out.append(said)
    return out


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_free_names(spark, block):
    r = random.Random(block)
    stems = ["a", "a (2)", "a (3)", "d/a", ".a", "x.y/b", "a (02)", "a (2) (2)", " (2)"]
    names = [r.choice([r.choice(stems) + r.choice(["", ".pdf", ".tar.gz"]), "a.pdf", "a.pdf", None]) for _ in range(300)]
    existing = [f"a ({k}).pdf" for k in (4, 5, 6, 9, 40, 41, 1, 0)] + ["a (2) (3).pdf", "b", "a (99999999999999999999).pdf", ".a", ".a (2)"]
    df = spark.createDataFrame([(i * 2 - 7, n, "q") for i, n in enumerate(names)], "p long, n string, name string")
    there = spark.createDataFrame([(e,) for e in [*existing, existing[0], None]], "e string")
    got = {r["p"]: r["free_name"] for r in archive.free_names(df, "n", "p", there, block).collect()}
    assert [got[i * 2 - 7] for i in range(300)] == plain_free(names, existing)
    assert archive.free_names(df.limit(0), "n", "p", there).count() == 0
    assert {r["free_name"] for r in archive.free_names(df.where("n = 'a.pdf'").limit(1), "n", "p", there.limit(0)).collect()} == {"a.pdf"}


def test_free_names_reads_its_rows_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(k):
        read.add(1)
        return (k, f"a ({k % 4}).pdf", "x" * k)

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(40), 2).map(seen), "p long, n string, other string")
    got = archive.free_names(df, "n", "p", spark.createDataFrame([("a (3).pdf",)], "e string")).collect()
    assert [r["free_name"] for r in sorted(got, key=lambda r: r["p"])] == plain_free([f"a ({k % 4}).pdf" for k in range(40)], ["a (3).pdf"])
    assert read.value <= 80  # once for counts, once for the rows


def test_safe_path(spark):
    cases = {
        "a/b.pdf": "a/b.pdf", "a\\b//c. .": "a/b/c", "": None, "/a": None, "\\a": None, "c:x": None, "a/../b": None, "./a": None, "...": "_", "con.txt": "_con.txt", "COM1": "_COM1", "COM0": "COM0", "conx": "conx", "a?b\x01": "a_b_",
        "x" * 130: "x" * 120, "/".join("a" * 24): "/".join("a" * 24), "/".join("a" * 25): None, "é:b": "é_b", "y" * 2049: None,
    }
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "p string")
    assert [r[0] for r in df.select(archive.safe_path(F.col("p"))).collect()] == [*cases.values(), None]


def test_archive_plan(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    listing = spark.createDataFrame([(f"/s/{k}", sha, n, kind) for k, n, kind in [("a", 1, "file"), ("big", archive.MAX_BYTES + 1, "file"), ("dir", 0, "directory"), ("max", archive.MAX_BYTES, "file"), ("../q", 1, "file")]] + [("/sx/a", sha, 1, "file"), ("rel", sha, 1, "file")], "path string, sha256 string, length long, kind string")
    rows = [
        ("/s/a", "t.pdf", sha.upper(), True, "copied", "t (2).pdf", None), ("/s/a", "t.pdf", sha, True, "copied", "t (4).pdf", None), ("/s/a", "n.pdf", sha, True, "copied", "n.pdf", None), ("/s/a", "n.pdf", sha, True, "copied", "n (2).pdf", None), ("/s/max", "m", sha, True, "copied", "m", None),
        ("rel", "t", sha, True, "failed", None, "not absolute"), (None, "t", sha, True, "failed", None, "not absolute"), ("/s/none", "t", sha, True, "failed", None, "not there"), ("/sx/a", "t", sha, True, "failed", None, "outside the source"), ("/s/../q", "t", sha, True, "failed", None, "outside the source"),
        ("/s/dir", "t", sha, True, "failed", None, "not a file"), ("/s/big", "t", sha, True, "failed", None, "too large"), ("/s/a", "t", "12", True, "failed", None, "no digest"), ("/s/a", "t", None, True, "failed", None, "no digest"), ("/s/a", "t", "0" * 64, True, "failed", None, "changed"), ("/s/a", "../t", sha, True, "failed", None, "unsafe target"),
        ("/s/a", "off", sha, False, None, None, None), ("/s/a", "off", sha, None, None, None, None),
    ]
    manifest = spark.createDataFrame([(i, *r[:4], "extra") for i, r in enumerate(rows)], "position long, path string, relative_path string, sha256 string, enabled boolean, kind string")
    existing = spark.createDataFrame([("t.pdf",), ("t (3).pdf",)], "e string")
    got = [tuple(r)[2:] for r in archive.archive_plan(manifest, listing, existing, "/s/").orderBy("position").collect()]
    assert got == [r[4:] for r in rows if r[3]]
    skipped = {r["position"]: (r["outcome"], r["target"], r["reason"]) for r in archive.archive_plan(manifest, listing, existing, "/s", "skip").collect()}
    assert [skipped[i] for i in range(5)] == [("skipped", None, "target exists")] * 2 + [("copied", "n.pdf", None), ("skipped", None, "target exists"), ("copied", "m", None)]
    assert [skipped[i] for i in range(5, 16)] == [r[4:] for r in rows[5:16]]
    with pytest.raises(ValueError, match="unknown conflict"):
        archive.archive_plan(manifest, listing, existing, "/s", "x")


def test_pads_of_all_bytes(spark):
    """A key's bytes that the pads turn into 0, and all others."""
    keys = [bytes(range(k, k + 64)) for k in (0, 64, 128, 192)] + [b"\x5c\x36\x00", b"", bytes(range(256))]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    for name in ("sha1", "sha512"):
        got = df.select("k", codes.hmac_by_key(F.lit(b"m"), F.col("k"), name).alias("v")).collect()
        assert all(r.v == hmac.new(bytes(r.k), b"m", getattr(hashlib, name)).hexdigest() for r in got)
