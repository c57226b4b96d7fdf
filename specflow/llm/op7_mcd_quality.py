"""Quality rules: fixed base rules and robust multivariate outliers per language and source.

Each document gets a vector of transformed statistics.  Per (lang, source) a
minimum-covariance-determinant estimate of their centre and scatter is found
by concentration steps, and documents far from the centre by Mahalanobis
distance are rejected.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_WS = " \t\n\x0b\x0c\r"
_WS_CLASS = r"[\x20\x09-\x0D]"
#: Statistics in the vector, and the least standard deviation that each may have:
#: differences that are small beside it are never a reason to reject.
FEATURES = {"log_word_len": 0.12, "symbol_share": 0.02, "mark_share": 0.02, "upper_share": 0.02,
            "dup_line_share": 0.08, "repeat_share": 0.06}
_N = list(FEATURES)
#: Share of a group's documents that the estimate covers, and the factor that makes
#: the scatter of the inner 75 % of six-dimensional normal data consistent.
INNER, CONSISTENCY = 0.75, 1.362
#: Values are whole multiples of this, so sums are exact and a median has few different values.
UNIT = 2.0 ** -10


def text_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts below (named with ``prefix``); the text is read once.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with
    a word), n_marks (ASCII punctuation), n_upper (A-Z).  A null text counts as empty.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    p = lambda x: f"{prefix}{x}"
    trimmed = F.btrim(t, F.lit(_WS))
    keep = lambda cls: F.length(F.regexp_replace(t, f"[^{cls}]++", "")).cast("long")
    d = docs.withColumn(p("_w"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WS_CLASS + "++")))
    d = d.withColumn(p("_l"), F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(_WS)) != ""))
    d = d.withColumn(p("_wh"), F.transform(p("_w"), lambda w: F.xxhash64(w)))
    n = F.size(p("_w"))
    gram = lambda i: F.xxhash64(*[F.get(F.col(p("_wh")), i + k) for k in range(5)])
    d = d.withColumn(p("_h"), F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), gram)))
    # windows found twice: neighbours in the order of (window, place); only where a window repeats
    again = F.size(F.array_distinct(p("_h"))) < F.size(p("_h"))
    d = d.withColumn(p("_s"), F.when(again, F.sort_array(F.transform(
        p("_h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    near = lambda e, k: F.coalesce(F.get(F.col(p("_s")), k)["h"] == e["h"], F.lit(False))
    d = d.withColumn(p("_p"), F.sort_array(F.transform(
        F.filter(p("_s"), lambda e, k: near(e, k - 1) | near(e, k + 1)), lambda e: e["i"])))
    covered = F.aggregate(
        F.zip_with(p("_p"), F.slice(p("_p"), 2, F.greatest(F.size(p("_p")), F.lit(1))), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(
        *[c for c in docs.columns], n.cast("long").alias(p("n_words")),
        F.length(F.array_join(p("_w"), "")).cast("long").alias(p("word_chars")),
        keep(r"#*$%&|<>").alias(p("n_symbols")),
        (F.size(p("_l")) - F.size(F.array_distinct(p("_l")))).cast("long").alias(p("n_dup_lines")),
        F.coalesce(F.when(F.col(p("_p")).isNotNull(), covered), F.lit(0)).cast("long").alias(p("n_repeat_words")),
        F.size(p("_l")).cast("long").alias(p("n_lines")),
        keep(r"!-/:-@\[-`{-~").alias(p("n_marks")), keep("A-Z").alias(p("n_upper")))


def vector(p: str) -> list[Column]:
    """The transformed statistics, in multiples of UNIT and between 0 and 16."""
    c = lambda x: F.col(f"{p}{x}").cast("double")
    chars = c("word_chars") + 50
    raw = {"log_word_len": F.log(F.greatest(c("word_chars"), F.lit(1.0)) / F.greatest(c("n_words"), F.lit(1.0))),
           "symbol_share": c("n_symbols") / chars, "mark_share": c("n_marks") / chars, "upper_share": c("n_upper") / chars,
           "dup_line_share": c("n_dup_lines") / (c("n_lines") + 3), "repeat_share": c("n_repeat_words") / (c("n_words") + 10)}
    return [(F.round(F.least(F.greatest(raw[k], F.lit(0.0)), F.lit(16.0)) / UNIT) * UNIT).alias(f"{p}{k}") for k in _N]


def _group_key(stats: DataFrame, lang: str, source: str, p: str, least: int) -> DataFrame:
    """Adds the group: (lang, source) if it has ``least`` documents, else what its
    language's small groups have together, else the rest of all languages."""
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    both = F.concat(null(lang), F.lit("\x01"), null(source)).alias(f"{p}g")
    n = (stats.select(null(lang).alias(f"{p}lang"), both).groupBy(f"{p}lang", f"{p}g").agg(F.count(F.lit(1)).alias(f"{p}n")))
    small = n.filter(F.col(f"{p}n") < least).groupBy(f"{p}lang").agg(F.sum(f"{p}n").alias(f"{p}m"))
    names = n.join(small, f"{p}lang", "left").select(f"{p}g", F.when(F.col(f"{p}n") >= least, F.col(f"{p}g"))
            .when(F.col(f"{p}m") >= least, F.col(f"{p}lang")).otherwise(F.lit("\x02")).alias(f"{p}key"))
    names = materialize(names, "quality-groups")
    return stats.withColumn(f"{p}g", both).join(hinted(names, is_small(names)), f"{p}g").drop(f"{p}g")


def is_small(groups: DataFrame, most: int = 100_000) -> bool:
    return groups.limit(most + 1).count() <= most


def hinted(groups: DataFrame, small: bool) -> DataFrame:
    """A table with a row per group: broadcast if there are at most 100,000 (some 30 MB),
    else joined by shuffle, where adaptive execution splits frequent groups."""
    return F.broadcast(groups) if small else groups


def _cholesky(groups: DataFrame) -> DataFrame:
    """Adds the lower triangle l_i_j of each group's scatter c_i_j, and log_det."""
    k = len(_N)
    for j in range(k):
        for i in range(j, k):
            x = F.col(f"c_{i}_{j}") - reduce(lambda a, b: a + b, [F.col(f"l_{i}_{m}") * F.col(f"l_{j}_{m}") for m in range(j)], F.lit(0.0))
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(x) if i == j else x / F.col(f"l_{j}_{j}"))
    return groups.withColumn("log_det", 2 * reduce(lambda a, b: a + b, [F.log(f"l_{i}_{i}") for i in range(k)]))


def with_distance(rows: DataFrame, groups: DataFrame, p: str) -> DataFrame:
    """Adds ``{p}d2``; the columns of ``groups`` are dropped again."""
    k = len(_N)
    cols = rows.columns
    d = rows.join(groups, f"{p}key")
    for i in range(k):
        rest = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{m}") * F.col(f"z_{m}") for m in range(i)], F.lit(0.0))
        d = d.withColumn(f"z_{i}", (F.col(f"{p}{_N[i]}") - F.col(f"mu_{i}") - rest) / F.col(f"l_{i}_{i}"))
    return d.select(*cols, reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(k)]).alias(f"{p}d2"))


def _scatter(groups: DataFrame, var: dict[tuple[int, int], Column]) -> DataFrame:
    k = len(_N)
    for i in range(k):
        for j in range(i + 1):
            floor = list(FEATURES.values())[i] ** 2 if i == j else 0.0
            groups = groups.withColumn(f"c_{i}_{j}", var.get((i, j), F.lit(0.0)) + floor)
    return _cholesky(groups)


def covariance_determinant(rows: DataFrame, p: str, most_steps: int = 100, tolerance: float = 1e-2) -> DataFrame:
    """Centre mu_i and scatter (as l_i_j) of each group's INNER share with, as far as
    concentration steps lead, the smallest determinant.

    Starts from medians and median absolute deviations.  A step ranks a group's
    documents by distance (in classes of 1/16 of a power of two), and takes mean and
    covariance of the nearest; they replace the group's estimate if its log determinant falls
    by over ``tolerance``.  Steps go on until no group's does, and fail if that takes more than
    ``most_steps``.
    Of the data only a row per group leaves a step.
    """
    k = len(_N)
    x = [F.col(f"{p}{f}") for f in _N]
    med = rows.groupBy(f"{p}key").agg(*[F.median(x[i]).alias(f"mu_{i}") for i in range(k)])
    med = materialize(med, "quality-medians")
    small = is_small(med)
    mad = rows.join(hinted(med, small), f"{p}key").groupBy(f"{p}key").agg(
        *[F.first(f"mu_{i}").alias(f"mu_{i}") for i in range(k)],
        *[F.median(F.abs(x[i] - F.col(f"mu_{i}"))).alias(f"mad_{i}") for i in range(k)])
    groups = _scatter(mad, {(i, i): F.pow(1.4826 * F.col(f"mad_{i}"), F.lit(2.0)) for i in range(k)})
    keep = [f"{p}key", "log_det", *[f"mu_{i}" for i in range(k)], *[f"l_{i}_{j}" for i in range(k) for j in range(i + 1)]]
    groups = materialize(groups.select(*keep), "quality-estimate")
    for step in range(most_steps):
        near = with_distance(rows, hinted(groups, small), p).withColumn(
            f"{p}bin", F.ceil(16 * F.log2(F.greatest(F.col(f"{p}d2"), F.lit(2.0 ** -20)))).cast("long"))
        edge = near.groupBy(f"{p}key").agg(F.ceil(F.percentile(f"{p}bin", INNER)).alias(f"{p}edge"))
        inner = near.join(hinted(edge, small), f"{p}key").filter(F.col(f"{p}bin") <= F.col(f"{p}edge"))
        m = inner.groupBy(f"{p}key").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s_{i}") for i in range(k)],
            *[F.sum(x[i] * x[j]).alias(f"s_{i}_{j}") for i in range(k) for j in range(i + 1)])
        m = m.select("*", *[(F.col(f"s_{i}") / F.col("n")).alias(f"mu_{i}") for i in range(k)])
        new = _scatter(m, {(i, j): CONSISTENCY * (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"mu_{i}") * F.col(f"mu_{j}"))
                           for i in range(k) for j in range(i + 1)}).select(*keep)
        old = groups.select(F.col(f"{p}key"), *[F.col(c).alias(f"old_{c}") for c in keep[1:]])
        # a group whose determinant no longer falls stays as it is
        falls = (F.col("log_det") < F.col("old_log_det") - tolerance) if step else F.lit(True)
        groups = materialize(new.join(hinted(old, small), f"{p}key").select(
            f"{p}key", *[F.when(falls, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in keep[1:]],
            falls.alias("falls")), "quality-estimate")
        if groups.filter("falls").isEmpty():
            return groups.drop("falls")
        groups = groups.drop("falls")
    raise RuntimeError(f"concentration steps still lower a determinant after {most_steps}")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  prefix: str = "q_", keep_text: bool = True, least_group: int = 50, radius: float = 5.5) -> DataFrame:
    """``docs`` with its statistics, base_failed and kept, each named with ``prefix``
    (which must not begin a column of ``docs``).

    base_failed: fewer than 10 words, or over 20 % of the words in 5-word windows that repeat
    in the text.  kept is false for base_failed documents and for those whose Mahalanobis
    distance from their group's robust centre is over ``radius`` (5.5: one in 30,000 of normal data).  The estimates come from
    documents that the base rules pass.  A null text has no words and fails; null
    languages and sources are groups of their own; small groups are judged together; an
    empty table gives an empty result; repeated rows count each.
    ``keep_text=False`` leaves the text column out of what is written and returned.
    """
    p = prefix
    if any(c.startswith(p) for c in docs.columns):
        raise ValueError(f"a column begins with {p!r}: choose another prefix")
    d = text_statistics(docs, text_col, p)
    if not keep_text:
        d = d.drop(text_col)
    failed = (F.col(f"{p}n_words") < 10) | (100 * F.col(f"{p}n_repeat_words") > 20 * F.col(f"{p}n_words"))
    d = materialize(d.select("*", *vector(p), failed.alias(f"{p}base_failed")), "quality-stats")
    d = _group_key(d, lang_col, source_col, p, least_group)
    fit = d.filter(~F.col(f"{p}base_failed")).select(f"{p}key", *[f"{p}{f}" for f in _N])
    groups = covariance_determinant(fit, p)
    left = [c for c in d.columns if c not in (f"{p}key", *[f"{p}{f}" for f in _N])]
    far = with_distance(d.filter(~F.col(f"{p}base_failed")), hinted(groups, is_small(groups)), p).select(
        *left, (F.col(f"{p}d2") <= radius * radius).alias(f"{p}kept"))
    return far.unionByName(d.filter(F.col(f"{p}base_failed")).select(*left, F.lit(False).alias(f"{p}kept")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns."""
    p = "q_"
    while any(c.startswith(p) for c in docs.columns):
        p = "_" + p
    return quality_rules(docs, prefix=p).filter(f"{p}kept").select(*docs.columns)
