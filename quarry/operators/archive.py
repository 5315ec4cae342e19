"""What becomes of the files of a manifest that are to be archived, and names that are free in a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.net import bound

#: Rows of one key that are numbered in one group.
BLOCK = 100_000
#: A file larger than this isn't copied.
MAX_BYTES = 100 * 1024 * 1024
#: Names that stand for devices.
DEVICES = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)"


def numbered(df: DataFrame, keys: list[str], position: str, out: str, block: int = BLOCK) -> DataFrame:
    """df with the row's number (from 1) among the rows of its keys by an integer position that differs within a key.

    Rows are counted in blocks of positions and numbered within them, so a key of any size is spread over many tasks.
    """
    cut = df.withColumn("_b", F.floor(F.col(position) / block))
    before = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(position))
    return cut.withColumn("_i", inside).join(before, [*keys, "_b"]).withColumn(out, F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def stem_and_extension(name: Column) -> tuple[Column, Column]:
    """A path's part before the last dot of its file name, and the rest from it; a dot at the start of the file name is no such dot."""
    extension = F.regexp_extract(name, r"(?s)[^/](\.[^./]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension)), extension


def gates(taken: DataFrame, block: int = BLOCK) -> DataFrame:
    """name, _j, _i of taken (name, k from 2): every j above _j of the free numbers of a name, 2, 3, 4 .., passes at least _i numbers that are taken.

    The i-th number taken, k, is passed by every j above k - 1 - i.
    """
    held = numbered(taken.select("name", "k").distinct(), ["name"], "k", "i", block)
    return held.groupBy("name", (F.col("k") - 1 - F.col("i")).alias("_j")).agg(F.max("i").alias("_i"))


def groups_and_gates(groups: DataFrame, passed: DataFrame, block: int = BLOCK) -> DataFrame:
    """groups (name, _b, _low, _high) with _past, the numbers passed by all of a group's j (above _low, up to _high), and those gates that only a part of a group passes, with its _b, as rows with _gate 1.

    Groups of a name follow each other in _b and j. Both come from running maxima over both tables, in blocks of values: neither a name
    with many groups nor one with many gates is one task. A group gets fewer gates than it has j.
    """
    both = groups.withColumn("_j", F.col("_low") + 1).withColumn("_gate", F.lit(0)).unionByName(passed.withColumn("_gate", F.lit(1)), allowMissingColumns=True).withColumn("_v", F.floor(F.col("_j") / block))
    most = both.groupBy("name", "_v").agg(*[F.max(c).alias(f"_m{c}") for c in ("_i", "_b", "_high")])
    before = Window.partitionBy("name").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    carry = most.select("name", "_v", *[F.max(f"_m{c}").over(before).alias(f"_past{c}") for c in ("_i", "_b", "_high")])
    inside = Window.partitionBy("name", "_v").orderBy("_j", "_gate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumns({f"_in{c}": F.max(c).over(inside) for c in ("_i", "_b", "_high")}).join(carry, ["name", "_v"])
    last = {c: F.coalesce(f"_in{c}", f"_past{c}") for c in ("_i", "_b", "_high")}
    # a group's first j passes the gates before it; a gate lies in the group that began last
    told = told.select("name", "_gate", "_j", "_low", last["_b"].alias("_b"), last["_high"].alias("_high"), F.when(F.col("_gate") == 1, F.col("_i")).otherwise(F.coalesce(last["_i"], F.lit(0))).alias("_i"))
    return told.where("_gate = 0 or _j < _high")


def free_names(df: DataFrame, name: str, position: str, existing: DataFrame, block: int = BLOCK) -> DataFrame:
    """df with `free_name`: the name itself for the first row that asks for it, if it doesn't exist; ` (2)`, ` (3)` .. before the extension for the others.

    A number is the least that gives a name which neither exists, nor is asked for by a row, nor was given to an earlier one. So names are
    unique, and a name with a number that some row asks for itself stays that row's. position: an integer that differs between
    rows; the earlier one goes first. existing: a column of names, repeats and nulls allowed. Rows with a null name get null.

    df is read twice: for the counts of its names in blocks of positions, and for its rows, which are shuffled once, by name and block; the numbers
    taken that lie in a block's range are laid among its rows.
    """
    there = existing.select(F.col(existing.columns[0]).alias("name")).where("name is not null").distinct().withColumn("_there", F.lit(True))
    cut = df.withColumn("_b", F.floor(F.col(position) / block))
    counts = cut.groupBy(F.col(name).alias("name"), "_b").agg(F.count("*").alias("_n")).where("name is not null")
    every = there.select("name", F.lit(1).cast("long").alias("_n")).unionByName(counts.groupBy("name").agg(F.sum("_n").alias("_n")))
    stem, extension = stem_and_extension(F.col("name"))
    number = r"(?s)^(.+) \(([1-9][0-9]{0,17})\)$"
    counted = lambda c: F.when(F.col("_n") > 0, c)  # noqa: E731  with the count, or Spark would ask each row for its stem and number before they are counted
    k = counted(F.regexp_extract(stem, number, 2)).try_cast("long")
    taken = every.select(counted(F.concat(F.regexp_extract(stem, number, 1), extension)).alias("name"), k.alias("k")).where("k >= 2")
    # the rows of a group have the j from _low + 1 to _high in the order of their positions; 0 keeps its name, another one gets the j-th free number
    high = F.sum("_n").over(Window.partitionBy("name").orderBy("_b")) - F.when(F.col("_there"), 0).otherwise(1)
    groups = counts.join(there, "name", "left").withColumn("_high", high).withColumn("_low", F.col("_high") - F.col("_n")).select("name", "_b", "_low", "_high")
    told = groups_and_gates(groups, gates(taken, block), block)
    begins = told.where("_gate = 0").select(F.col("name").alias("_name"), F.col("_b").alias("_group"), "_low", F.col("_i").alias("_past"), stem.alias("_stem"), extension.alias("_extension"))
    laid = told.where("_gate = 1").select(F.col("name").alias(name), "_b", "_j", "_i", "_gate")
    rows = cut.withColumn("_gate", F.lit(0)).unionByName(laid, allowMissingColumns=True)
    group = Window.partitionBy("_b", name)
    rows = rows.withColumn("_r", F.row_number().over(group.orderBy("_gate", position)))
    rows = rows.join(begins, (F.col("_b") == F.col("_group")) & (F.col(name) == F.col("_name")), "left").withColumn("_j", F.coalesce("_j", F.col("_low") + F.col("_r")))
    inside = F.max("_i").over(group.orderBy("_j", "_gate").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_in", inside).where("_gate = 0")
    free = F.col("_j") + 1 + F.coalesce("_in", "_past")
    said = F.when(F.col("_j") > 0, F.concat("_stem", F.lit(" ("), free.cast("string"), F.lit(")"), "_extension")).otherwise(F.col(name))
    return rows.select(*df.columns, said.alias("free_name"))


def safe_path(path: Column) -> Column:
    """A relative path with / between its parts, each without forbidden characters, ends of blanks and dots and names of devices, 120 characters at most; null if it isn't one.

    It isn't one if it is empty, longer than 2048 bytes, starts with / or a back slash or a drive, has . or .. as a part, or no or more than 24 parts.
    """
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/", -1), lambda p: p != "")

    def clean(p: Column) -> Column:
        bare = F.substring(F.rtrim(F.regexp_replace(p, r'[<>:"|?*\x00-\x1f\x7f-\u009f]', "_"), F.lit(" .")), 1, 120)
        return bound(bare, lambda b: F.when(b == "", "_").when(b.rlike(DEVICES), F.concat(F.lit("_"), b)).otherwise(b))

    good = (path != "") & (F.octet_length(path) <= 2048) & ~path.rlike(r"^[/\\]|^[\x00-\x7f]:")
    return F.when(good, bound(parts, lambda x: F.when(F.size(x).between(1, 24) & ~F.exists(x, lambda p: p.isin(".", "..")), F.array_join(F.transform(x, clean), "/"))))


def archive_plan(manifest: DataFrame, listing: DataFrame, existing: DataFrame, root: str, conflict: str = "rename", block: int = BLOCK) -> DataFrame:
    """outcome (copied, skipped, failed), target and reason of each enabled row of a manifest.

    manifest: position (an integer that differs between rows), path, relative_path, sha256, enabled. listing: path, sha256, length and kind of what is there now (a path
    once). existing: names in the target. A row fails, in this order, for a path that isn't absolute or listed, lies outside `root`, is no
    file, is too large, whose digest is no digest or no longer right, or whose relative path isn't safe. conflict: with skip, a row whose target exists or is an
    earlier row's is skipped; with rename it gets a free name. Null counts as not so.
    """
    now = listing.select(F.col("path").alias("_path"), F.lower("sha256").alias("_sha"), F.col("length").alias("_length"), F.col("kind").alias("_kind"))
    # a safe path is found before the join: after it, each use of the name would find it again
    rows = manifest.where("enabled").select("position", "path", safe_path(F.col("relative_path")).alias("_safe"), F.lower("sha256").alias("sha256")).join(now, F.col("path") == F.col("_path"), "left")
    folder = root.rstrip("/") + "/"
    wrong = [
        (F.col("path").startswith("/"), "not absolute"),
        (F.col("_path").isNotNull(), "not there"),
        (F.col("path").startswith(folder) & ~F.col("path").rlike(r"/\.\.?(/|$)"), "outside the source"),
        (F.col("_kind") == "file", "not a file"),
        (F.col("_length") <= MAX_BYTES, "too large"),
        (F.col("sha256").rlike("^[0-9a-f]{64}$"), "no digest"),
        (F.col("sha256") == F.col("_sha"), "changed"),
        (F.col("_safe").isNotNull(), "unsafe target"),
    ]
    reason = F.coalesce(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(why)) for good, why in wrong])
    judged = rows.withColumn("reason", reason).withColumn("asked", F.when(F.col("reason").isNull(), F.col("_safe"))).select("position", "path", "asked", "reason")
    if conflict == "rename":
        named = free_names(judged, "asked", "position", existing, block)
        return named.select("position", "path", F.when(F.col("reason").isNull(), "copied").otherwise("failed").alias("outcome"), F.col("free_name").alias("target"), "reason")
    if conflict != "skip":
        raise ValueError(f"unknown conflict rule {conflict}")
    there = existing.select(F.col(existing.columns[0]).alias("asked")).distinct().withColumn("_there", F.lit(True))
    first = judged.where("asked is not null").groupBy("asked").agg(F.min("position").alias("_first"))
    told = judged.join(first, "asked", "left").join(there, "asked", "left")
    late = F.col("asked").isNotNull() & (F.coalesce(F.col("_there"), F.lit(False)) | (F.col("position") != F.col("_first")))
    outcome = F.when(F.col("reason").isNotNull(), "failed").when(late, "skipped").otherwise("copied")
    return told.select("position", "path", outcome.alias("outcome"), F.when(outcome == "copied", F.col("asked")).alias("target"), F.when(late, "target exists").otherwise(F.col("reason")).alias("reason"))
