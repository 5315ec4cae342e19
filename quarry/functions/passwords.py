"""Passwords drawn from a seed a row, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of characters that passwords are made of.
CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digits": "0123456789", "symbols": "!@#$%^&*()-_=+[]{};:,.<>?/~"}


def password(seed: Column, length: int = 20, classes: list[str] | None = None, exclude: str = "", ensure_all: bool = True) -> Column:
    """A password of 4 to 128 characters of the given classes (all if not said) without the excluded ones; null for a null seed.

    With ensure_all each class that has characters left is there at least once, unless there are more classes than
    characters. Draws are 48 bits of sha256(seed, purpose, place), and places are put in the order of another such digest: equal seeds give equal
    passwords, on any machine and in any partition. The seed must be as secret, and have as many random bits, as the password is to have.
    """
    wanted = list(CLASSES) if classes is None else classes
    if unknown := set(wanted) - set(CLASSES):
        raise ValueError(f"unknown classes {sorted(unknown)}")
    left = ["".join(c for c in CLASSES[k] if c not in exclude) for k in CLASSES if k in wanted]
    groups = [g for g in left if g]
    if not groups:
        raise ValueError("no class of characters is left")
    size, pool = max(4, min(128, length)), "".join(groups)
    sure = groups if ensure_all and size >= len(groups) else []
    drawn = lambda purpose, i: F.sha2(F.concat(seed.cast("string"), F.lit(f":{purpose}:"), i.cast("string")), 256)

    def character(i: Column) -> Column:
        number = F.conv(F.substring(drawn("draw", i), 1, 12), 16, 10).cast("long")
        one = lambda signs: F.substring(F.lit(signs), (number % len(signs) + 1).cast("int"), F.lit(1))
        out = one(pool)
        for k, g in enumerate(sure):
            out = F.when(i == k, one(g)).otherwise(out)
        return out

    dealt = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(drawn("place", i).alias("at"), character(i).alias("c")))
    return F.when(seed.isNotNull(), F.array_join(F.transform(F.array_sort(dealt), lambda x: x["c"]), ""))
