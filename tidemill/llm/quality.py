"""Quality rules: counts of each text, and robust outliers per language and source. DataFrame functions only.

Rows that pass the base rules give statistics, of which logarithms are taken: words, letters a word, symbols a word,
repeated lines and repeated words. Each language and source has its minimum-covariance-determinant estimate: from
several starts (median and spread of each statistic, and the signs around the median), concentration steps take the
SHARE of rows nearest by Mahalanobis distance and estimate anew. Distances are counted on a fine grid; of the cell that the
last ones lie in, as much counts as makes the share exact. A start goes on as long as a step lowers its determinant by
STANDS or more (of its logarithm), and keeps the least; the start that ends with the least is taken. Languages and all rows together have estimates too: that of a group of n rows counts n / (n + PRIOR), and
its language's, in the same way blended with that of all rows, the rest. So a source with few rows is judged much as its
language is, one with many by itself, and nothing switches in between.

A row is rejected if its distance, scaled so that the median row is as far as in a normal population, is over CUTOFF,
the outer fence of the chi-square distribution's logarithm: its upper quartile and three times the quartiles' difference.

Statistics are whole numbers of 1 / SCALE, so that sums are exact and reruns agree; quantiles come from counts of
distances on a fine grid, so that no group is sorted or collected.

Nulls: a null text has no words; null language and source are values of their own. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import WORD_REGEX, stored, table

#: Fixed values of the contract.
SYMBOLS, LEAST_WORDS, MOST_REPEAT_PERCENT = r"[#*$%&|<>]", 50, 50
STATS = ["s_words", "s_length", "s_symbols", "s_lines", "s_repeats"]
SCALE, FLOOR, SHARE, PRIOR, MOST_STEPS, STANDS = 100, 0.25, 0.75, 200, 100, 1e-3
#: Quantiles 0.25, 0.5 and 0.75 of chi-square with 5 degrees of freedom.
CHI2_LOW, CHI2_HALF, CHI2_HIGH = 2.6746, 4.3515, 6.6257
CUTOFF = CHI2_HIGH * (CHI2_HIGH / CHI2_LOW) ** 3
GRID = 16
#: More groups than that are joined by shuffling over salts instead of broadcast.
BROADCAST_GROUPS, SALTS = 5_000, 32


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words in windows of three that the text has twice or more: windows sorted by their words' hash, compared with
    their neighbours, and the places of equal ones covered once."""
    n = F.size(words)

    def places(s: Column) -> Column:
        same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def count(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda a, g: a + g))

    def sorted_count(w: Column) -> Column:
        unique = F.size(F.array_distinct(F.transform(w, lambda x: x["h"]))) == F.size(w)
        return F.when(unique, 0).otherwise(let(F.sort_array(w), lambda s: let(places(s), count)))

    return F.when(n < 4, 0).otherwise(let(windows, sorted_count))


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_REGEX))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        _repeated(w).cast("long").alias("n_repeat_words"),
    )
    rows = docs.select(
        *keep,
        let(F.regexp_extract_all(text, F.lit(WORD_REGEX), F.lit(0)), of_words).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    rows = rows.select(*keep, "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words")))


def statistics(rows: DataFrame) -> DataFrame:
    """Adds STATS, in whole numbers of 1 / SCALE."""
    whole = lambda c: F.round(SCALE * c).cast("long")
    each = F.greatest("n_words", F.lit(1))
    return (
        rows.withColumn("s_words", whole(F.log1p("n_words")))
        .withColumn("s_length", whole(F.log1p(F.col("word_chars") / each) * 2))
        .withColumn("s_symbols", whole(F.log1p(100 * F.col("n_symbols") / each)))
        .withColumn("s_lines", whole(F.log1p(100 * F.col("n_dup_lines") / each)))
        .withColumn("s_repeats", whole(F.log1p(10 * F.col("n_repeat_words") / each)))
    )


def group(level: int) -> Column:
    """A row's language and source, its language, or all."""
    names = ["lang", "source"][: 2 - level]
    return F.xxhash64(F.lit(level), *[x for n in names for x in (F.col(n).isNull(), F.coalesce(n, F.lit("")))])


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(g and STATS of rows, once for each of a row's groups; g0, g1, g2 and n0, n1, the numbers of rows of the first two;
    whether the groups are few)."""
    keys = [group(i) for i in range(3)]
    groups = rows.select(*[k.alias(f"g{i}") for i, k in enumerate(keys)]).groupBy("g0", "g1", "g2").agg(F.count(F.lit(1)).alias("n0"))
    groups = stored(groups.withColumn("n1", F.sum("n0").over(Window.partitionBy("g1"))), "quality-groups")
    return stored(rows.select(F.explode(F.array(*keys)).alias("g"), *STATS), "quality-rows"), groups, groups.count() <= BROADCAST_GROUPS


def joined(rows: DataFrame, groups: DataFrame, on, few: bool, how: str = "inner") -> DataFrame:
    """rows with their group's columns: by broadcast if the groups are few, else shuffled, the groups once for each salt."""
    if few:
        return rows.join(F.broadcast(groups), on, how)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("own_salt", F.pmod(F.xxhash64(*STATS), F.lit(SALTS)).cast("int")) if "s_words" in rows.columns else rows.withColumn("own_salt", F.lit(0))
    if isinstance(on, str):
        return own.withColumnRenamed("own_salt", "salt").join(salted, [on, "salt"], how).drop("salt")
    return own.join(salted, on & (F.col("own_salt") == F.col("salt")), how).drop("salt", "own_salt")


PAIRS = list(combinations_with_replacement(range(len(STATS)), 2))


def _cholesky(s: DataFrame) -> DataFrame:
    """From columns c_i_j the factor l_i_j (lower), and logdet."""
    d = len(STATS)
    for j in range(d):
        own = F.col(f"c_{j}_{j}")
        for k in range(j):
            own = own - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        s = s.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(own, F.lit(1e-6))))
        for i in range(j + 1, d):
            x = F.col(f"c_{j}_{i}")
            for k in range(j):
                x = x - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            s = s.withColumn(f"l_{i}_{j}", x / F.col(f"l_{j}_{j}"))
    logdet = sum((2 * F.log(f"l_{i}_{i}") for i in range(1, d)), 2 * F.log("l_0_0"))
    return s.withColumn("logdet", logdet).drop(*[f"c_{i}_{j}" for i, j in PAIRS])


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(len(STATS)):
        z = F.col(STATS[i]) / SCALE - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, len(STATS))), F.col("z_0") * F.col("z_0"))
    return rows.withColumn("d2", total).drop(*[f"z_{i}" for i in range(len(STATS))])


def _cell(d2: Column) -> Column:
    return F.floor(GRID * F.log2(F.greatest(d2, F.lit(1e-4)))).cast("int")


ESTIMATE = ["g", "start"] + [f"m_{i}" for i in range(5)] + [f"l_{i}_{j}" for j, i in PAIRS] + ["logdet"]


def first_estimates(rows: DataFrame, few: bool) -> DataFrame:
    """Two starts for each group: medians with spreads, and medians with the covariance of signs times the spreads."""
    tall = rows.select("g", F.posexplode(F.array(*STATS)).alias("i", "v"))
    cells = tall.groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("c"))

    def medians(cells: DataFrame, name: str) -> DataFrame:
        up = Window.partitionBy("g", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy("g", "i")
        half = cells.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(every)).where("2 * upto >= n")
        return half.groupBy("g", "i").agg(F.min("v").alias(name))

    med = medians(cells, "med")
    away = cells.join(med, ["g", "i"]).withColumn("v", F.abs(F.col("v") - F.col("med"))).groupBy("g", "i", "v").agg(F.sum("c").alias("c"))
    spread = medians(away, "mad")
    both = med.join(spread, ["g", "i"]).groupBy("g")
    wide = both.agg(*[F.max(F.when(F.col("i") == i, F.col("med"))).alias(f"med_{i}") for i in range(5)], *[F.max(F.when(F.col("i") == i, F.col("mad"))).alias(f"mad_{i}") for i in range(5)])
    for i in range(5):
        wide = wide.withColumn(f"m_{i}", F.col(f"med_{i}") / SCALE).withColumn(f"sd_{i}", F.greatest(1.4826 * F.col(f"mad_{i}") / SCALE, F.lit(FLOOR)))
    wide = stored(wide.select("g", *[f"m_{i}" for i in range(5)], *[f"sd_{i}" for i in range(5)]), "quality-medians")
    plain = wide
    for i, j in PAIRS:
        plain = plain.withColumn(f"c_{i}_{j}", F.col(f"sd_{i}") * F.col(f"sd_{i}") if i == j else F.lit(0.0))
    signs = joined(rows, wide, "g", few)
    for i in range(5):
        signs = signs.withColumn(f"u_{i}", (F.col(STATS[i]) / SCALE - F.col(f"m_{i}")) / F.col(f"sd_{i}"))
    norm = F.sqrt(sum((F.col(f"u_{i}") * F.col(f"u_{i}") for i in range(1, 5)), F.col("u_0") * F.col("u_0")))
    signs = signs.withColumn("norm", F.greatest(norm, F.lit(1e-9)))
    exact = lambda x: F.sum(F.round(1e6 * x).cast("decimal(20,0)"))
    cov = signs.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[exact(F.col(f"u_{i}") * F.col(f"u_{j}") / F.col("norm") / F.col("norm")).alias(f"q_{i}_{j}") for i, j in PAIRS])
    turned = wide.join(cov, "g")
    for i, j in PAIRS:
        value = 5 * F.col(f"q_{i}_{j}").cast("double") / 1e6 / F.col("n") * F.col(f"sd_{i}") * F.col(f"sd_{j}")
        turned = turned.withColumn(f"c_{i}_{j}", value + (FLOOR * FLOOR if i == j else 0))
    names = ["g", *[f"m_{i}" for i in range(5)], *[f"c_{i}_{j}" for i, j in PAIRS]]
    starts = plain.select(F.lit(0).alias("start"), *names).unionByName(turned.select(F.lit(1).alias("start"), *names))
    return stored(_cholesky(starts).select(*ESTIMATE), "quality-start")


def concentrated(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """One concentration step: means and covariances of the SHARE of rows nearest to each estimate."""
    near = _distance(joined(rows, estimates, "g", few)).withColumn("cell", _cell(F.col("d2")))
    sums = [F.sum(F.col(s).cast("decimal(20,0)")).alias(f"s_{i}") for i, s in enumerate(STATS)]
    squares = [F.sum((F.col(STATS[i]) * F.col(STATS[j])).cast("decimal(20,0)")).alias(f"q_{i}_{j}") for i, j in PAIRS]
    cells = near.groupBy("g", "start", "cell").agg(F.count(F.lit(1)).alias("n"), *sums, *squares)
    every = Window.partitionBy("g", "start")
    half = F.ceil(SHARE * F.sum("n").over(every))
    inside = cells.withColumn("part", (half - (F.sum("n").over(every.orderBy("cell")) - F.col("n"))) / F.col("n")).where("part > 0")
    names = [f"s_{i}" for i in range(5)] + [f"q_{i}_{j}" for i, j in PAIRS]
    # whole cells are added up exactly; at most one counts in part
    share = lambda x: (F.coalesce(F.sum(F.when(F.col("part") >= 1, F.col(x))), F.lit(0)).cast("double") + F.coalesce(F.max(F.when(F.col("part") < 1, F.col(x).cast("double") * F.col("part"))), F.lit(0.0))).alias(x)
    s = inside.groupBy("g", "start").agg(share("n"), *[share(x) for x in names])
    for i in range(5):
        s = s.withColumn(f"m_{i}", F.col(f"s_{i}") / F.col("n") / SCALE)
    for i, j in PAIRS:
        c = F.col(f"q_{i}_{j}") / F.col("n") / SCALE / SCALE - F.col(f"m_{i}") * F.col(f"m_{j}")
        s = s.withColumn(f"c_{i}_{j}", c + (FLOOR * FLOOR if i == j else 0))
    return stored(_cholesky(s).select(*ESTIMATE), "quality-step")


def settled(rows: DataFrame, first: DataFrame, few: bool) -> DataFrame:
    """The estimate of each group and start when no step lowers its determinant any more. Those that stand take no part in
    further steps. Every step that goes on lowers a determinant by STANDS, and none is under FLOOR's, so steps end."""
    going, out = concentrated(rows, first, few), []
    for _ in range(MOST_STEPS):
        was = going.select("g", "start", F.col("logdet").alias("was"))
        lower = concentrated(rows, going, few).join(was, ["g", "start"]).where(F.col("logdet") < F.col("was") - STANDS)
        lower = stored(lower.select(*ESTIMATE), "quality-lower")
        out.append(going.join(lower.select("g", "start"), ["g", "start"], "left_anti"))
        going = lower
        if going.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, out)
    raise RuntimeError(f"estimates did not stand in {MOST_STEPS} steps")


def estimated(rows: DataFrame, few: bool) -> DataFrame:
    """The estimate of each group of rows (g, STATS), with scale, which makes the median squared distance CHI2_HALF."""
    estimates = settled(rows, first_estimates(rows, few), few)
    best = stored(estimates.groupBy("g").agg(F.min_by(F.struct(*ESTIMATE[1:]), F.struct("logdet", "start")).alias("e")).select("g", "e.*"), "quality-best")
    cells = _distance(joined(rows, best, "g", few)).withColumn("cell", _cell(F.col("d2"))).groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("g")
    half = cells.withColumn("upto", F.sum("n").over(every.orderBy("cell"))).withColumn("total", F.sum("n").over(every)).where("2 * upto >= total")
    scale = half.groupBy("g").agg(F.least(F.lit(1.0), CHI2_HALF / F.pow(F.lit(2.0), (F.min("cell") + 1) / GRID)).alias("scale"))
    return stored(best.join(scale, "g"), "quality-estimates")


def blended(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """g0 with the estimate its rows are judged by: its own, its language's and that of all rows, by their numbers of rows."""
    own, lang = (F.col(f"n{i}") / (F.col(f"n{i}") + PRIOR) for i in range(2))
    weights = [own, (1 - own) * lang, (1 - own) * (1 - lang)]
    for level in range(3):
        e = estimates.select(F.col("g").alias(f"g{level}"), F.struct(*[f"m_{i}" for i in range(5)], *[f"l_{i}_{j}" for j, i in PAIRS], "scale").alias(f"e{level}"))
        groups = groups.join(e, f"g{level}")
    mix = lambda f: sum((weights[i] * f(F.col(f"e{i}")) for i in (1, 2)), weights[0] * f(F.col("e0")))
    squares = lambda i, j: lambda e: sum((e[f"l_{i}_{k}"] * e[f"l_{j}_{k}"] for k in range(1, i + 1)), e[f"l_{i}_0"] * e[f"l_{j}_0"])
    means = [mix(lambda e, i=i: e[f"m_{i}"]).alias(f"m_{i}") for i in range(5)]
    covariances = [mix(squares(i, j)).alias(f"c_{i}_{j}") for i, j in PAIRS]
    scale = F.exp(mix(lambda e: F.log(e["scale"]))).alias("scale")
    return stored(_cholesky(groups.select("g0", *means, *covariances, scale)), "quality-blended")


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, the counts, d2 (squared distance; null for rows that fail the base rules) and kept."""
    keep = [c for c in keep if c not in ("lang", "source")]
    rows = stored(statistics(counts(docs.withColumns({c: F.col(c).cast("string") for c in ("lang", "source")}), [*keep, "lang", "source"])), "quality-counts")
    good = rows.where("NOT base_failed")
    levels, groups, few = grouped(good)
    estimates = blended(groups, estimated(levels, few))
    far = _distance(joined(good.withColumn("g0", group(0)), estimates, "g0", few, "left")).withColumn("d2", F.col("d2") * F.col("scale"))
    names = [*keep, "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = rows.where("base_failed").select(*names, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    bad = F.coalesce(F.col("d2") > CUTOFF, F.lit(False))
    return far.select(*names, "d2", (~bad).alias("kept")).unionByName(failed)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
