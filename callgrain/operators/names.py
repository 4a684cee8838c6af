"""Place names against an official list: overrides first, then the best fuzzy match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.functions.similarity import name_ratio
from callgrain.functions.text import match_form
from callgrain.plans.skew import skew_join
from callgrain.session import materialize

# A text key that stands for "no segment: any common letter".
_LETTER = -1
# Pairs of names that one key may make in one task, and names of one side of a key that is split.
PAIRS_PER_TASK, SIDE = 4_000_000, 2_000
_KEY = ["g", "a_len", "b_len", "key"]


def _distance_limit(a_len: Column, b_len: Column, threshold: int) -> Column:
    """Most letters that two names may not share and still reach the threshold after rounding."""
    total = a_len + b_len
    limit = F.floor(total * F.lit((100.5 - threshold) / 100) + F.lit(1e-9)).cast("int")
    # the distance is odd exactly where the total length is
    return limit - F.pmod(limit - total, F.lit(2))


def _partner_lengths(length: Column, threshold: int) -> Column:
    """Lengths a partner can have: the shorter name may be wholly contained in the longer one."""
    share = (threshold - 0.5) / 100
    low = F.ceil(length * F.lit(share / (2 - share)) - F.lit(1e-9)).cast("int")
    high = F.floor(length * F.lit((2 - share) / share) + F.lit(1e-9)).cast("int")
    return F.sequence(F.greatest(low, F.lit(1)), high)


def _segment(i: Column, b_len: Column, n: Column) -> tuple[Column, Column]:
    start = F.floor(i * b_len / n).cast("int")
    return start, F.floor((i + 1) * b_len / n).cast("int") - start


def _met(t: DataFrame, c: DataFrame, n_pairs: int) -> DataFrame:
    """The join of both sides on their keys; keys with too many pairs are cut on both sides.

    A common segment, or a letter of short names, may hold a large share of the names. Its targets
    are dealt out over T parts and its choices over C, and each meets all parts of the other side, so
    every pair still meets once, in one of T x C tasks.
    """
    if n_pairs <= PAIRS_PER_TASK:
        return t.join(c, _KEY)
    t, c = materialize(t, "target-keys"), materialize(c, "choice-keys")
    n_t = t.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_t"))
    n_c = c.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_c"))
    heavy = n_t.join(n_c, _KEY).where(F.col("n_t") * F.col("n_c") > PAIRS_PER_TASK)
    parts = [F.ceil(F.col(n) / SIDE).cast("int").alias(p) for n, p in (("n_t", "t_parts"), ("n_c", "c_parts"))]
    heavy = materialize(heavy.select(*_KEY, *parts), "heavy-keys")
    if heavy.isEmpty():
        return t.join(c, _KEY)

    def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        mine, theirs = F.coalesce(f"{own}_parts", F.lit(1)), F.coalesce(f"{other}_parts", F.lit(1))
        known = skew_join(side, heavy, _KEY, [name], "left")
        salted = known.withColumn(f"{own}_salt", F.pmod(F.xxhash64(name), mine).cast("int"))
        return salted.withColumn(f"{other}_salt", F.explode(F.sequence(F.lit(0), theirs - 1))).drop("t_parts", "c_parts")

    return dealt(t, "a", "t", "c").join(dealt(c, "b", "c", "t"), [*_KEY, "t_salt", "c_salt"]).drop("t_salt", "c_salt")


def candidate_pairs(targets: DataFrame, choices: DataFrame, threshold: int, n_pairs: int = 0) -> DataFrame:
    """All (g, a, b) of one group that can reach the threshold, and some more; never all pairs.

    If at most k letters are not shared, then of k+1 segments of ``b`` one stands unbroken in ``a``,
    shifted by no more than the letters allow. Both sides are keyed by (lengths, segment number,
    segment text), so an ordinary equi-join finds every pair. Names too short for k+1 segments are
    keyed by their letters: above threshold 0 a pair has one in common. ``n_pairs`` is the number of
    all pairs: only where it is large can a key be too large for a task.
    """
    both = [F.col("a_len"), F.col("b_len")]

    c = (
        choices.select("g", "b", F.length("b").alias("b_len"))
        .withColumn("a_len", F.explode(_partner_lengths(F.col("b_len"), threshold)))
        .withColumn("k", _distance_limit(*both, threshold))
        .where((F.col("k") >= F.abs(F.col("a_len") - F.col("b_len"))))
    )
    n = F.col("k") + 1

    def choice_key(i: Column) -> Column:
        start, size = _segment(i, F.col("b_len"), n)
        return F.struct(i.alias("seg"), F.substr(F.col("b"), start + 1, size).alias("text"))

    def letters(col: str) -> Column:
        return F.transform(
            F.array_distinct(F.split(F.col(col), "")),
            lambda ch: F.struct(F.lit(_LETTER).alias("seg"), ch.alias("text")),
        )

    segmented = n <= F.col("b_len")
    c = c.select(
        "g", "b", "b_len", "a_len", "k",
        F.explode(
            F.when(segmented, F.transform(F.sequence(F.lit(0), F.col("k")), choice_key)).otherwise(letters("b"))
        ).alias("key"),
    )

    t = (
        targets.select("g", "a", F.length("a").alias("a_len"))
        .withColumn("b_len", F.explode(_partner_lengths(F.col("a_len"), threshold)))
        .withColumn("k", _distance_limit(*both, threshold))
        .where((F.col("k") >= F.abs(F.col("a_len") - F.col("b_len"))))
    )
    surplus = F.col("a_len") - F.col("b_len")
    shifts = F.sequence(
        F.ceil((surplus - F.col("k")) / 2).cast("int"), F.floor((surplus + F.col("k")) / 2).cast("int")
    )

    def target_keys(i: Column) -> Column:
        start, size = _segment(i, F.col("b_len"), n)
        fits = F.filter(
            F.transform(shifts, lambda s: s + start), lambda p: (p >= 0) & (p + size <= F.col("a_len"))
        )
        return F.transform(
            fits, lambda p: F.struct(i.alias("seg"), F.substr(F.col("a"), p + 1, size).alias("text"))
        )

    t = t.select(
        "g", "a", "a_len", "b_len",
        F.explode(
            F.array_distinct(
                F.when(
                    segmented, F.flatten(F.transform(F.sequence(F.lit(0), F.col("k")), target_keys))
                ).otherwise(letters("a"))
            )
        ).alias("key"),
    )
    pairs = _met(t, c, n_pairs)
    # substitutions count once here and twice in the score, so nothing that can pass is lost
    return pairs.where(F.expr("levenshtein(a, b, k)") >= 0).select("g", "a", "b").distinct()


def match_names(
    targets: DataFrame,
    choices: DataFrame,
    overrides: DataFrame | None = None,
    threshold: int = 80,
    target_col: str = "target",
    choice_col: str = "choice",
    group_col: str | None = None,
) -> DataFrame:
    """(target, match, score, via) for every distinct target; match is null below the threshold.

    An override (raw, official) wins without a score; of equal scores the first choice by name wins.
    Repeated names are collapsed first, so a name with a third of all rows costs as much as any other.
    With ``group_col``, say the state of a district, which both tables have, a target is matched with
    the choices of its own group alone, and the group is a column of the result; groups are compared
    by their normalised spelling, and overrides count for a group if they have the column.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be between 1 and 100")
    group = match_form(F.col(group_col)) if group_col else F.lit("")
    shown = F.col(group_col) if group_col else F.lit("")
    names = targets.select(F.col(target_col).alias("target"), shown.alias("shown"), group.alias("g")).where(F.col("target").isNotNull()).distinct()
    if overrides is None:
        overrides = targets.sparkSession.createDataFrame([], "raw string, official string")
    by_group = group_col is not None and group_col in overrides.columns
    fixed_key = [F.col("raw").alias("target")] + ([group.alias("g")] if by_group else [])
    fixed = overrides.groupBy(*fixed_key).agg(F.min("official").alias("official"))
    names = names.join(fixed, ["target", "g"] if by_group else ["target"], "left")

    forms = names.where(F.col("official").isNull()).select("target", "g", match_form(F.col("target")).alias("a"))
    by_form = materialize(
        choices.select(F.col(choice_col).alias("choice"), group.alias("g"), match_form(F.col(choice_col)).alias("b"))
        .where(F.length("b") > 0)
        .groupBy("g", "b")
        .agg(F.min("choice").alias("choice")),
        "choice-forms",
    )
    a_forms = forms.select("g", "a").where(F.length("a") > 0).distinct()
    # nothing beats the same name, so such targets need no search
    same = a_forms.join(by_form.withColumnRenamed("b", "a"), ["g", "a"])
    exact = same.select("g", "a", F.col("choice").alias("fuzzy"), F.lit(100).alias("score"))
    searched = materialize(a_forms.join(by_form.select("g", F.col("b").alias("a")), ["g", "a"], "left_anti"), "target-forms")
    n_pairs = searched.count() * by_form.count()
    scored = candidate_pairs(searched, by_form, threshold, n_pairs).select(
        "g", "a", "b", name_ratio(F.col("a"), F.col("b")).alias("score")
    )
    best = (
        scored.where(F.col("score") >= threshold)
        .join(by_form, ["g", "b"])
        .groupBy("g", "a")
        .agg(F.min(F.struct((-F.col("score")).alias("neg"), "choice")).alias("best"))
        .select("g", "a", F.col("best.choice").alias("fuzzy"), (-F.col("best.neg")).alias("score"))
        .unionByName(exact)
    )
    found = forms.join(best, ["g", "a"]).select("target", "g", "fuzzy", "score")
    return names.join(found, ["target", "g"], "left").select(
        *([F.col("shown").alias(group_col)] if group_col else []),
        "target",
        F.coalesce("official", "fuzzy").alias("match"),
        "score",
        F.when(F.col("official").isNotNull(), "override").when(F.col("fuzzy").isNotNull(), "fuzzy").alias("via"),
    )


def unmatched(matches: DataFrame) -> DataFrame:
    """Targets left for review."""
    return matches.where(F.col("match").isNull()).select("target")


def remaining(choices: DataFrame, matches: DataFrame, choice_col: str = "choice") -> DataFrame:
    """Choices no target was matched to, sorted."""
    used = matches.where(F.col("match").isNotNull()).select(F.col("match").alias(choice_col)).distinct()
    return choices.select(choice_col).distinct().join(used, choice_col, "left_anti").orderBy(choice_col)


def suggest(df: DataFrame, col: str, typed: str, n: int) -> DataFrame:
    """Entries that contain the typed text, ignoring case, in order."""
    hit = F.contains(F.lower(F.col(col)), F.lit(typed.lower()))
    return df.where(hit).select(col).distinct().orderBy(col).limit(n)
