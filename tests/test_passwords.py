import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import passwords
from quarry.functions.passwords import CLASSES


def plain(seed, length, groups, sure):
    drawn = lambda purpose, i: hashlib.sha256(f"{seed}:{purpose}:{i}".encode()).hexdigest()
    pick = lambda i, signs: signs[int(drawn("draw", i)[:12], 16) % len(signs)]
    made = [pick(i, groups[i] if sure and i < len(groups) else "".join(groups)) for i in range(length)]
    return "".join(made[i] for i in sorted(range(length), key=lambda i: drawn("place", i)))


@pytest.mark.parametrize(("length", "classes", "exclude", "ensure"), [(20, None, "", True), (4, None, "O0l1I", True), (1, ["digits", "upper"], "0123456789", True), (500, ["symbols"], "é", False), (8, ["lower", "digits"], "abc", True)])
def test_password(spark, length, classes, exclude, ensure):
    seeds = [f"s{i}" for i in range(60)] + ["", "𝔘", "s1"]
    df = spark.createDataFrame([(s,) for s in [*seeds, None]], "seed string")
    got = [r[0] for r in df.select(passwords.password(F.col("seed"), length, classes, exclude, ensure)).collect()]
    size = max(4, min(128, length))
    groups = [g for g in ("".join(c for c in v if c not in exclude) for k, v in CLASSES.items() if classes is None or k in classes) if g]
    assert got == [plain(s, size, groups, ensure and size >= len(groups)) for s in seeds] + [None]
    assert all(len(p) == size and set(p) <= set("".join(groups)) for p in got[:-1])
    assert not ensure or all(set(p) & set(g) for p in got[:-1] for g in groups)


def test_places_are_mixed(spark):
    """The character that a class is sure of stands anywhere, about as often."""
    rows = spark.range(2000).select(passwords.password(F.col("id"), 8, ["digits", "lower"]).alias("p")).select(F.regexp_instr("p", F.lit("[0-9]")).alias("at"), F.substring("p", 1, 1).rlike("[0-9]").alias("first")).collect()
    assert {r["at"] for r in rows} == set(range(1, 9))
    assert 0.25 < sum(r["first"] for r in rows) / 2000 < 0.5  # 1/8 + 7/8 * 10/36 = 0.368


def test_refused():
    for bad in ({"classes": []}, {"classes": ["digits"], "exclude": "0123456789"}, {"classes": ["letters"]}):
        with pytest.raises(ValueError, match="class"):
            passwords.password(None, **bad)
