"""Texts that are alike by the ratio of their matching blocks, found through what such texts must share.

The ratio of texts of a and b characters is 2 M / T, T = a + b, where M characters lie in blocks that match. Between two
blocks at least one character of one text is left over, so that there are at most T - 2 M + 1 blocks and at least
3 M - T - 1 pairs of neighbouring characters in common. Texts over a least ratio therefore share one of their rarest
pairs, and only such texts are compared.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from assayline.sources.workdir import stored

#: The roles and elements in which an action looks for its target; other actions look in the last set.
ROLES: dict[str, tuple[str, ...]] = {
    "fill": ("input", "textarea", "textbox", "searchbox", "contenteditable"),
    "press": ("input", "textarea", "textbox", "searchbox", "contenteditable"),
    "select": ("select", "listbox", "combobox", "option"),
    "hover": ("button", "a", "link", "menuitem", "tab", "menu", "haspopup", "tooltip"),
    "": ("button", "a", "link", "menuitem", "tab"),
}
#: Rounding of least * T must not raise a bound.
_SLACK = 1e-9


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


# Said to be nondeterministic, so that a test of the ratio is not moved ahead of the cheaper ones.
_ratio = F.pandas_udf(_ratios, DoubleType()).asNondeterministic()


def _numbered(text: Column, size: int) -> Column:
    """All runs of so many characters, each with the number of equal ones before it: a multiset as an array without repeats."""
    n = F.char_length(text) - size + 1
    runs = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(size)))
    sorted_ = F.array_sort(runs)
    return F.transform(sorted_, lambda r, i: F.concat(r, F.lit("#"), (i + 1 - F.array_position(sorted_, r)).cast("string")))


def similar_texts(left: DataFrame, right: DataFrame, keys: list[str], least: float, strict: bool = True) -> DataFrame:
    """left (keys, a), right (keys, b) → (keys, a, b, ratio) of distinct texts of equal keys with a ratio over least (or,
    not strict, of least). Equal texts are always compared, empty ones too; null ones never.

    Keys may be null and then match nothing. Candidates come from equi-joins; the ratio alone runs in Python.
    """
    size = 2 if 1.5 * least > 1.05 else 1
    grow = 1.5 * least - 1 if size == 2 else least / 2  # of the least overlap, by character of both texts

    def described(df: DataFrame, name: str) -> DataFrame:
        t = df.where(F.col(name).isNotNull()).select(*keys, name).distinct()
        return t.withColumn("n", F.char_length(name)).withColumn("chars", _numbered(F.col(name), 1)).withColumn("runs", _numbered(F.col(name), size) if size > 1 else F.col("chars"))

    x, y = stored(described(left, "a"), "texts"), stored(described(right, "b"), "texts")
    # The least overlap of a text of n characters with any partner: that with its shortest possible one.
    shared = F.ceil((F.col("n") + F.ceil(F.col("n") * least / (2 - least) - _SLACK)) * grow - (1 if size == 2 else 0) - _SLACK)
    # So short that pairs say nothing: such texts, and all that may be their partners, meet by single characters.
    short = next(n for n in range(1, 1000) if (2 * n / (2 - least)) * grow - (1 if size == 2 else 0) > 0) - 1
    often = y.select(F.explode("runs").alias("g")).groupBy("g").count()

    def elements(df: DataFrame, name: str) -> DataFrame:
        each = df.where(F.col("n") > short).select(*keys, name, shared.alias("shared"), F.size("runs").alias("held"), F.explode("runs").alias("g"))
        ranked = each.join(often, "g", "left").groupBy(*keys, name, "shared", "held").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "g"))).alias("gs"))
        some = ranked.select(*keys, name, F.explode(F.slice("gs", F.lit(1), F.greatest(F.col("held") - F.col("shared") + 1, F.lit(1)).cast("int"))).alias("s")).select(*keys, name, F.col("s.g").alias("g"))
        tiny = df.where(F.col("n") <= short * (2 - least) / least + _SLACK).select(*keys, name, F.explode(F.transform("chars", lambda c: F.concat(F.lit("="), c))).alias("g"))
        return some.unionByName(tiny)

    # Texts and their runs repeat, so that files of them are small where the rows are not: none go through the driver.
    met = elements(x, "a").join(elements(y, "b").hint("merge"), [*keys, "g"]).select(*keys, "a", "b")
    equal = x.select(*keys, "a").join(y.select(*keys, F.col("b").alias("a"), "b").hint("merge"), [*keys, "a"]).select(*keys, "a", "b")
    met = met.unionByName(equal).distinct()
    told = [F.col(c) for c in ("n", "chars", "runs")]
    both = met.join(x.select(*keys, "a", *(c.alias(f"a_{k}") for c, k in zip(told, ("n", "chars", "runs"), strict=True))).hint("merge"), [*keys, "a"])
    both = both.join(y.select(*keys, "b", *(c.alias(f"b_{k}") for c, k in zip(told, ("n", "chars", "runs"), strict=True))).hint("merge"), [*keys, "b"])
    total = F.col("a_n") + F.col("b_n")
    matched = F.ceil(total * least / 2 - _SLACK)
    likely = (matched <= F.least("a_n", "b_n")) & (F.size(F.array_intersect("a_chars", "b_chars")) >= matched)
    if size == 2:
        likely = likely & (F.size(F.array_intersect("a_runs", "b_runs")) >= 3 * matched - total - 1)
    scored = both.where(likely).select(*keys, "a", "b", _ratio("a", "b").alias("ratio"))
    return scored.where(F.col("ratio") > least if strict else F.col("ratio") >= least)


def best_fuzzy_match(targets: DataFrame, elements: DataFrame, threshold: float = 0.8, roles: dict[str, tuple[str, ...]] = ROLES) -> DataFrame:
    """targets (id, page, action, target) × elements (page, ordinal, role, disabled, text) → (id, ordinal, text, ratio).

    Each target gets the element of its page, among those of its action's roles that are enabled and have a text, with the
    highest ratio over the threshold; of equal ratios the first in page order. Targets of one character or none, and
    those without such an element, give no row. Equal texts of a page are compared once.
    """
    kinds = list(roles)
    which = F.lower("action")
    asked = targets.where(F.char_length("target") > 1).select("id", "page", F.when(which.isin(*[k for k in kinds if k]), which).otherwise("").alias("kind"), F.col("target").alias("a"))
    homes = F.filter(F.array(*(F.when(F.col("role").isin(*roles[k]), F.lit(k)) for k in kinds)), lambda k: k.isNotNull())
    offered = elements.where(~F.coalesce("disabled", F.lit(False)) & (F.char_length("text") > 0)).select("page", F.explode(homes).alias("kind"), F.col("text").alias("b"), "ordinal")
    first = offered.groupBy("page", "kind", "b").agg(F.min("ordinal").alias("ordinal"))
    pairs = similar_texts(asked, first, ["page", "kind"], threshold).join(first, ["page", "kind", "b"])
    best = pairs.groupBy("page", "kind", "a").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "ordinal", "b")).alias("m"))
    return asked.join(best, ["page", "kind", "a"]).select("id", F.col("m.ordinal").alias("ordinal"), F.col("m.b").alias("text"), (-F.col("m.less")).alias("ratio"))
