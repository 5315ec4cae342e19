"""Quality rules: counts of a text's words, symbols, lines and repetitions, then robust multivariate outliers.

For each language and source the centre and scatter of a vector of transformed statistics are those of the
`part` of its texts with the smallest determinant of covariance (minimum covariance determinant). Concentration
steps look for it from several starts: medians with absolute deviations, mean and covariance of all, covariance
of the directions from the median, the half nearest to the median, and ELEMENTAL small subsets drawn by seeded
hashes. A step keeps the `part` of texts nearest by Mahalanobis distance and takes their mean and covariance. All
starts make two steps; the BEST with the least determinants go on until the logarithm of the determinant falls
by less than TOLERANCE, and the least of all is taken. Covariances have the squared FLOORS added, quantiles are
approximate (1 in ACCURACY of the ranks). Distances are scaled so that their median is that of a chi-square
distribution; texts beyond the cut are rejected. Texts that fail the base rules are rejected first and
don't enter the estimates.

A group of fewer than `least` texts that pass the base rules is judged by the estimate of all groups
together; without any, all distances are null and base rules alone decide. Null lang or source are groups
of their own. Null text has no words and fails. Repeated rows are judged alike; empty tables give empty
results; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import NO_WORDS, SPACES, durable, release

SYMBOLS = "#*$%&|<>"
#: Floors of the standard deviations of the statistics, in their transformed units: a statistic that hardly varies must not reject.
FLOORS = (0.15, 0.5, 0.35, 0.12)
#: Medians and 1 - 1e-6 quantiles of the chi-square distribution with 4 degrees of freedom.
MEDIAN_4, CUT_4 = 3.3567, 33.377
ELEMENTAL, SUBSET, BEST, TOLERANCE, ACCURACY, MOST_SENT = 4, 6, 2, 1e-4, 2000, 20_000


def base_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of docs (doc_id, text, lang, source).

    Repetitions are found without a pair of windows: window hashes are sorted with their places, a place is
    repeated if its neighbour in that order has the same hash, and the stretches after repeated places are
    measured up to the next repeated place. Two windows count as equal if their 64-bit hashes are.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", text.alias("_t"))
    d = d.withColumn("_w", F.split(F.trim("_t", F.lit(SPACES)), NO_WORDS, -1)).withColumn("_l", lines_of("_t"))
    d = d.select(
        "doc_id", "lang", "source", "_w",
        F.when(F.col("_w")[0] == "", 0).otherwise(F.size("_w")).cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("_p", F.expr("if(size(_w) < 3, array(), transform(slice(_w, 1, size(_w) - 2), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2])))")).drop("_w")
    # most texts have no window twice and need no order
    d = d.withColumn("_p", F.expr("if(size(array_distinct(_p)) = size(_p), array(), sort_array(transform(_p, (h, i) -> struct(h as h, i as i))))"))
    # true where the next window in the order is the same
    d = d.withColumn("_e", F.expr("if(size(_p) < 2, array(), zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (a, b) -> a.h = b.h))"))
    d = d.withColumn("_q", F.expr("if(size(_p) < 2, array(), sort_array(filter(zip_with(zip_with(array_append(_e, false), array_prepend(_e, false), (a, b) -> a or b), _p, (e, p) -> if(e, p.i, null)), x -> x is not null)))"))
    repeat = F.expr("if(size(_q) = 0, 0, 3 + aggregate(zip_with(slice(_q, 2, size(_q)), slice(_q, 1, size(_q) - 1), (b, a) -> least(3, b - a)), 0, (s, x) -> s + x))")
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.cast("long").alias("n_repeat_words"))


def lines_of(text: str) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def vector() -> list[Column]:
    """Transformed statistics: log mean word length, log share of symbols, log of repeated lines, share of repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(F.col("word_chars") / n + 1), F.log1p(100 * F.col("n_symbols") / n), F.log1p(F.col("n_dup_lines").cast("double")), F.col("n_repeat_words") / n]


def distance(params: str = "_m") -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor in params (m0.., l00, l10, ..)."""
    y: list[Column] = []
    for i in range(4):
        v = F.col(f"x{i}") - F.col(f"{params}.m{i}")
        for j in range(i):
            v = v - F.col(f"{params}.l{i}{j}") * y[j]
        y.append(v / F.col(f"{params}.l{i}{i}"))
    return y[0] * y[0] + y[1] * y[1] + y[2] * y[2] + y[3] * y[3]


def factor(df: DataFrame) -> DataFrame:
    """df with c00, c10, .. (a covariance) and m0.. to df with the Cholesky factor l00, .. instead, floors added."""
    for i in range(4):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 / 4))) if i == j else v / F.col(f"l{j}{j}"))
    return df


def moments() -> list[Column]:
    """Means, covariances and count of x0..x3."""
    out = [F.avg(f"x{i}").alias(f"m{i}") for i in range(4)]
    out += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(4) for j in range(i + 1)]
    return [*out, F.count(F.lit(1)).alias("_n")]


PARAMS = [f"m{i}" for i in range(4)] + [f"l{i}{j}" for i in range(4) for j in range(i + 1)]
LOG_DET = "2 * (ln(l00) + ln(l11) + ln(l22) + ln(l33))"


def covariance(value) -> list[Column]:
    """c00, c10, .. by a function of two places."""
    return [value(i, j).cast("double").alias(f"c{i}{j}") for i in range(4) for j in range(i + 1)]


def started(rows: DataFrame, key: str, starts: list[str] | None = None) -> DataFrame:
    """key, s (the start) and PARAMS for each group of rows (key, x0..x3); starts: those wanted, or all."""
    quarters = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], ACCURACY).alias(f"q{i}") for i in range(4)]
    drawn = [F.min_by(F.struct(*[f"x{i}" for i in range(4)]), F.xxhash64(*[f"x{i}" for i in range(4)], F.lit(k))).alias(f"d{k}") for k in range(ELEMENTAL * SUBSET)]
    first = durable(rows.groupBy(key).agg(*quarters, *moments(), *drawn))
    median, scale = [F.col(f"q{i}")[1] for i in range(4)], [F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2) for i in range(4)]
    out = [first.select(key, F.lit("median").alias("s"), *[m.alias(f"m{i}") for i, m in enumerate(median)], *covariance(lambda i, j: scale[i] * scale[i] if i == j else F.lit(0.0)))]
    out.append(first.select(key, F.lit("mean").alias("s"), *[f"m{i}" for i in range(4)], *[f"c{i}{j}" for i in range(4) for j in range(i + 1)]))
    for k in range(ELEMENTAL):
        d = [F.col(f"d{k * SUBSET + n}") for n in range(SUBSET)]
        mean = [sum((x[f"x{i}"] for x in d[1:]), d[0][f"x{i}"]) / SUBSET for i in range(4)]
        out.append(first.select(key, F.lit(f"drawn {k}").alias("s"), *[m.alias(f"m{i}") for i, m in enumerate(mean)], *covariance(lambda i, j: sum((x[f"x{i}"] * x[f"x{j}"] for x in d[1:]), d[0][f"x{i}"] * d[0][f"x{j}"]) / SUBSET - mean[i] * mean[j])))
    # standard units about the median: directions, and the nearest half
    units = rows.join(sent(first).select(key, *[m.alias(f"_m{i}") for i, m in enumerate(median)], *[v.alias(f"_s{i}") for i, v in enumerate(scale)]), key)
    units = units.withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}") for i in range(4)}).withColumn("_r", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, 4)), F.col("z0") * F.col("z0")))
    signs = [F.avg(F.when(F.col("_r") > 0, F.col(f"z{i}") * F.col(f"z{j}") / F.col("_r")).otherwise(0.0) * F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"c{i}{j}") for i in range(4) for j in range(i + 1)]
    way = durable(units.groupBy(key).agg(*[F.first(f"_m{i}").alias(f"m{i}") for i in range(4)], *signs, F.percentile_approx("_r", 0.5, ACCURACY).alias("_half")))
    out.append(way.select(key, F.lit("signs").alias("s"), *out[1].columns[2:]))
    near = units.join(sent(way).select(key, "_half"), key).where("_r <= _half").groupBy(key).agg(*moments())
    out.append(near.select(key, F.lit("near half").alias("s"), *out[1].columns[2:]))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    every = durable(factor(every if starts is None else every.where(F.col("s").isin(starts))).select(key, "s", *PARAMS))
    release(first, way)
    return every


def concentrated(rows: DataFrame, now: DataFrame, key: str, part: float) -> DataFrame:
    """now (key, s, PARAMS) after a concentration step on rows (key, x0..x3), with log_det."""
    params = F.struct(*PARAMS).alias("_m")
    top = durable(rows.join(sent(now).select(key, "s", params), key).groupBy(key, "s").agg(F.percentile_approx(distance(), part, ACCURACY).alias("_top")))
    kept = rows.join(sent(now.join(top, [key, "s"])).select(key, "s", "_top", params), key).where(distance() <= F.col("_top"))
    out = durable(factor(kept.groupBy(key, "s").agg(*moments())).select(key, "s", *PARAMS).withColumn("log_det", F.expr(LOG_DET)))
    release(top)
    return out


def sent(params: DataFrame) -> DataFrame:
    """A table with a row a group and start, sent to all tasks if it has at most MOST_SENT rows (of 16 numbers); else it is joined by sorting."""
    return F.broadcast(params) if params.count() <= MOST_SENT else params


def least_first(now: DataFrame, key: str, most: int) -> DataFrame:
    """Of each group the `most` rows of least determinant, ties by the start's name; a group has few rows, one a start."""
    return now.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("log_det", "s"))).where(F.col("_r") <= most).drop("_r")


def estimates(rows: DataFrame, key: str, part: float, starts: list[str] | None = None) -> DataFrame:
    """key, s (the start that won), log_det, _m (centre and factor), _scale of each group of rows (key, x0..x3)."""
    now = started(rows, key, starts)
    for _ in range(2):
        now, before = concentrated(rows, now, key, part), now
        release(before)
    now, before = durable(least_first(now, key, BEST)), now
    release(before)
    ended = None
    while True:
        after = concentrated(rows, now, key, part)
        both = after.join(now.select(key, "s", F.col("log_det").alias("_was")), [key, "s"])
        falls = F.col("log_det") < F.col("_was") - TOLERANCE
        stays = durable(now.join(both.where(~falls).select(key, "s"), [key, "s"], "left_semi"))
        ended = stays if ended is None else ended.unionByName(stays)
        now = durable(both.where(falls).drop("_was"))
        release(after)
        if now.isEmpty():
            break
    best = durable(least_first(ended, key, 1).select(key, "s", "log_det", F.struct(*PARAMS).alias("_m")))
    scale = rows.join(sent(best), key).groupBy(key).agg(F.percentile_approx(distance(), 0.5, ACCURACY).alias("_md"))
    return best.join(scale.select(key, F.greatest(F.col("_md") / MEDIAN_4, F.lit(1.0)).alias("_scale")), key)


def quality_rules(docs: DataFrame, least_words: int = 50, repeat_percent: int = 50, part: float = 0.75, least: int = 40, cut: float = CUT_4) -> DataFrame:
    """doc_id, the five statistics, base_failed, distance and kept for each row of docs (doc_id, text, lang, source)."""
    stats = base_stats(docs).withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    group = F.to_json(F.struct("lang", "source")).alias("_g")  # nulls are left out, so they are a group of their own
    stats = durable(stats.select("*", group, *[v.alias(f"x{i}") for i, v in enumerate(vector())]))
    good = stats.where(~F.col("base_failed")).select("_g", *[f"x{i}" for i in range(4)])
    sizes = durable(good.groupBy("_g").count())
    large, small = sizes.where(F.col("count") >= least).select("_g"), not sizes.where(F.col("count") < least).isEmpty()
    rows = good.join(sent(large), "_g")
    # if a group is small, all texts together are one more group, of the empty name
    rows = durable(rows.unionByName(good.withColumn("_g", F.lit(""))) if small else rows)
    found = durable(estimates(rows, "_g", part))
    every = found.where(F.col("_g") == "").first() if small else None  # a row of 15 numbers
    judged = stats.join(sent(found).where(F.col("_g") != "").select("_g", "_m", "_scale"), "_g", "left")
    if every:
        other = F.struct(*[F.lit(every["_m"][k]).alias(k) for k in PARAMS])
        judged = judged.withColumn("_m", F.coalesce("_m", other)).withColumn("_scale", F.coalesce("_scale", F.lit(every["_scale"])))
    judged = judged.withColumn("distance", distance() / F.col("_scale"))
    release(sizes, rows)
    stays = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), stays.alias("kept"))
