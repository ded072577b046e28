"""Quality rules: robust multivariate outliers by minimum covariance determinant, with SQL functions only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, stored

REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Share of a group whose covariance has the least determinant, and least rows of a group with an estimate of its own.
SUPPORT, MIN_GROUP = 0.75, 50
#: Concentration steps from each start, most of them in all, and the change of a logarithm of a determinant that ends them.
START_STEPS, MOST_STEPS, SETTLED = 2, 30, 1e-9
#: What makes the covariance of the nearest three quarters that of all, if these are normal: 0.75 / F6(q), q the 0.75 quantile of chi-square with 4 degrees.
CONSISTENCY = 1.4867
#: Squared robust distance beyond which a row is an outlier: the 1 - 1e-6 quantile of chi-square with 4 degrees.
CUTOFF = 33.377
#: Least standard deviation of each transformed statistic: below it a spread is rounding or chance.
FLOORS = (0.15, 0.25, 0.4, 0.3)
VECTOR = ("x0", "x1", "x2", "x3")
SPACE = r"[\x20\x09-\x0D]+"


def _repeated(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text."""
    n = REPEAT_WINDOW
    empty = F.lit(0)
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))

    def among(hs: Column) -> Column:
        # sorted (hash, place): a place repeats if its neighbour has its hash
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            size = F.size(s)
            last = lambda k: F.get(s, k)["h"]
            marked = F.filter(F.transform(s, lambda x, k: F.when(last(k - 1).eqNullSafe(x["h"]) | (k + 1 < size) & last(k + 1).eqNullSafe(x["h"]), x["i"])), lambda i: i.isNotNull())
            return bound(F.sort_array(marked), lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - i, F.lit(n)))), F.lit(0), add))

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), empty).otherwise(bound(ordered, places))

    return F.when(F.size(words) > n, bound(hashes, among)).otherwise(empty)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row, from its whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    words = bound(F.array_remove(F.split("text", SPACE), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")))
    lines = bound(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.size(F.split("text", r"[#*$%&|<>]")) - 1
    return rows.select("doc_id", "lang", "source", words.alias("w"), symbols.cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines")).select(
        "doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def _transformed() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    return [F.log(F.greatest("word_chars", F.lit(1)) / words), F.log1p(100 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
            F.log1p("n_dup_lines"), F.log1p(10 * F.col("n_repeat_words") / words)]


def _sums(columns: list[Column]) -> list[Column]:
    """Sums for means and covariances of four columns; a group of any size is added up within its tasks first."""
    k = range(len(VECTOR))
    return [F.count("*").alias("n"), *(F.sum(columns[i]).alias(f"s{i}") for i in k), *(F.sum(columns[i] * columns[j]).alias(f"s{i}{j}") for i in k for j in k if j <= i)]


def _estimate(sums: DataFrame) -> DataFrame:
    """(g, centre m, lower Cholesky factor l, logarithm of the determinant) from sums; no variance is below its floor."""
    k = range(len(VECTOR))
    covariance = lambda i, j: CONSISTENCY * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n"))
    out = sums.select("g", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in k),
                      *((F.greatest(covariance(i, i), F.lit(FLOORS[i] ** 2)) if i == j else covariance(i, j)).alias(f"c{i}{j}") for i in k for j in k if j <= i))
    return _factor(out)


def _factor(moments: DataFrame) -> DataFrame:
    """The lower factor of each covariance, column by column."""
    out, k = moments, range(len(VECTOR))
    for j in k:
        for i in range(j, len(VECTOR)):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{q}") * F.col(f"l{j}{q}") for q in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6) * F.col(f"c{j}{j}"))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = reduce(add, (2 * F.log(f"l{i}{i}") for i in k))
    return out.select("g", *(f"m{i}" for i in k), *(f"l{i}{j}" for i in k for j in range(i + 1)), log_det.alias("log_det"))


def _distances(rows: DataFrame, model: DataFrame, *more: str) -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance under the model of their g (null where it has none), and further columns of the model.

    A model is one row a group; Spark joins it by shuffle or broadcast as its size allows.
    """
    out = rows.join(model, "g", "left")
    for i in range(len(VECTOR)):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{q}") * F.col(f"z{q}") for q in range(i)), F.lit(0.0))
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return out.select(*rows.columns, reduce(add, (F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(VECTOR)))).alias("d2"), *more)


def _step(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step: the estimate of the rows of each group within its ``SUPPORT`` quantile of distance.

    Distances are counted in bins of a hundredth of their logarithm: a histogram of a few thousand
    bins a group whatever its size. The quantile's bin is written beside the model, so that the
    second pass over the rows again joins one small table.
    """
    place = F.floor(F.log(F.col("d2") + 1e-6) * 100)
    counts = _distances(rows, model).groupBy("g", place.alias("bin")).agg(F.count("*").alias("n"))
    counts = counts.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("edge"))
    add_bin = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["seen"] < SUPPORT * F.col("total"), x["bin"]).otherwise(s["edge"]).alias("edge"))
    edges = counts.select("g", F.aggregate("bins", start, add_bin)["edge"].alias("edge"))
    edged = stored(model.join(edges, "g"), "robust_edges")
    near = _distances(rows, edged, "edge").where(place <= F.col("edge"))
    return stored(_estimate(near.groupBy("g").agg(*_sums([F.col(x) for x in VECTOR]))), "robust_model")


def fit(rows: DataFrame) -> DataFrame:
    """Centre and factor of each group's minimum-covariance-determinant estimate, over ``rows`` (g, x0..x3).

    Three starts: medians with the interquartile ranges as spreads, means with covariances, and both
    of values drawn in to 2.5 spreads around the median. Each gets ``START_STEPS`` concentration
    steps: keep the share ``SUPPORT`` of rows nearest to the estimate, estimate from those. The start
    of the least determinant goes on until no group's determinant changes. Each model is written to
    the shared folder; what reaches the driver is one number a step.
    """
    k = range(len(VECTOR))
    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(VECTOR)]
    first = stored(rows.groupBy("g").agg(*quartiles, *_sums([F.col(x) for x in VECTOR])), "robust_starts")
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in k]
    middle = [F.col(f"q{i}")[1] for i in k]
    by_medians = _factor(first.select("g", *(middle[i].alias(f"m{i}") for i in k), *((spread[i] * spread[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in k for j in k if j <= i)))
    bounds = stored(first.select("g", *((middle[i] - 2.5 * spread[i]).alias(f"lo{i}") for i in k), *((middle[i] + 2.5 * spread[i]).alias(f"hi{i}") for i in k)), "robust_bounds")
    drawn_in = [F.greatest(F.least(f"x{i}", f"hi{i}"), f"lo{i}") for i in k]
    starts = [by_medians, _estimate(first), _estimate(rows.join(bounds, "g").groupBy("g").agg(*_sums(drawn_in)))]
    named = [x.withColumn("g", F.concat(F.lit(str(i)), "g")) for i, x in enumerate(starts)]
    model = stored(reduce(DataFrame.unionByName, named), "robust_model")
    thrice = rows.select(F.explode(F.array(*(F.concat(F.lit(str(i)), "g") for i in range(len(starts))))).alias("g"), *VECTOR)
    for _ in range(START_STEPS):
        model = _step(thrice, model)
    least = model.groupBy(F.substring("g", 2, 1 << 30).alias("own")).agg(F.min_by("g", F.struct(F.round("log_det", 9), "g")).alias("g"))
    model = stored(model.join(least, "g").drop("g").withColumnRenamed("own", "g"), "robust_model")
    for _ in range(MOST_STEPS - START_STEPS):
        before, model = model, _step(rows, model)
        change = model.join(before.select("g", F.col("log_det").alias("old")), "g").agg(F.max(F.abs(F.col("log_det") - F.col("old")))).first()[0]
        if change is None or change < SETTLED:
            break
    return model


def _groups(passing: DataFrame) -> DataFrame:
    """(pair, model, trains): for each language and source the group whose model judges its rows, and the groups that its rows are learned in.

    A pair of fewer than ``MIN_GROUP`` rows is judged by its language, and a language of fewer by all rows.
    """
    sizes = stored(passing.groupBy("pair", "language").agg(F.count("*").alias("n")), "quality_groups")
    languages = sizes.groupBy("language").agg(F.sum("n").alias("n_language"), F.min("n").alias("least"))
    known = sizes.join(languages, "language").withColumn("model", F.when(F.col("n") >= MIN_GROUP, F.col("pair")).when(F.col("n_language") >= MIN_GROUP, F.col("language")).otherwise(F.lit("all")))
    whole = not languages.where(F.col("n_language") < MIN_GROUP).isEmpty()
    trains = F.array(F.when(F.col("n") >= MIN_GROUP, F.col("pair")), F.when((F.col("least") < MIN_GROUP) & (F.col("n_language") >= MIN_GROUP), F.col("language")), F.lit("all" if whole else None))
    return stored(known.select("pair", "model", F.array_compact(trains).alias("trains")), "quality_groups")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of each row.

    A row is kept unless a base rule fails or its transformed statistics lie beyond the robust
    distance ``CUTOFF`` (squared) of its language and source. The estimate is learned from rows that
    pass the base rules; pairs of few rows take their language's estimate, and languages of few rows
    that of all, so every row that passes has a distance. A null language or source is a group of
    its own. Distance is null for a row that fails in a pair where none passes. A null text has no
    words and fails. Ids may be null or repeat, repeated rows are each returned; other columns are
    not used.
    """
    found = stored(statistics(docs, id_col, text_col, lang_col, source_col), "quality_statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # to_json leaves null fields out, so keys are null-safe; the prefixes keep pairs and languages apart
    pair, language = F.concat(F.lit("pair"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("language"), F.to_json(F.struct("lang")))
    rows = found.select("*", failed.alias("base_failed"), pair.alias("pair"), language.alias("language"), *(x.alias(f"x{i}") for i, x in enumerate(_transformed())))
    passing = rows.where(~F.col("base_failed"))
    groups = _groups(passing)
    model = fit(passing.join(groups, "pair").select(F.explode("trains").alias("g"), *VECTOR))
    judged = _distances(rows.join(groups.select("pair", F.col("model").alias("g")), "pair", "left"), model)
    far = F.coalesce(F.col("d2") > CUTOFF, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), F.sqrt("d2").alias("distance"))
