"""Mixing documents to target weights: raking to source, language and topic marginals, then calibrated sampling.

Tokens are summed by cell (source, language, topic), with partial sums before the
shuffle, so a source with a third of all rows is a few rows. Iterative proportional
fitting runs on the cells: in each sweep every dimension's weights are scaled to its
target shares. A document of a cell is then kept with the probability that makes the
expected tokens follow the weights. DataFrame expressions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.llm.shared import stored
from assayline.sources.tables import ship, table

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixConfig:
    """targets: shares of tokens by dimension and value, as in {"lang": {"en": 0.5, "de": 0.2}}; values not named share
    what is left as their tokens do. A dimension without targets follows power: its observed shares to this power,
    scaled to sum to 1 (1: as found, 0: all alike). keep: expected share of all tokens to keep. sweeps: sweeps of fitting
    between looks at the marginals, rounds: looks at most, tolerance: greatest deviation of a marginal's share.
    strict: raise where the marginals can't be reached, else the nearest fit counts. fills: rounds that hand what full
    cells can't give to the others. broadcast_cells: cells up to which they are broadcast."""

    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    power: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.8, "topic": 0.8})
    keep: float = 0.6
    sweeps: int = 6
    rounds: int = 4
    tolerance: float = 1e-6
    strict: bool = False
    fills: int = 8
    seed: str = "mix"
    broadcast_cells: int = 50_000


def word_count(text: Column) -> Column:
    """Words of a text; an empty or null text counts as one, so that its documents are sampled like others."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(1)).cast("long")


def content_topic(text: Column, words: Column) -> Column:
    """A coarse topic from what a text is made of: licence terms, code and tables, figures, questions, or plain prose."""
    without = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    signs = without("{") + without(";") + without("=") + without("|") + without("<")
    legal = text.contains("licen") | text.contains("Licen") | text.contains("opyright")
    return (
        F.when(legal, "legal")
        .when(signs * 10 >= words, "code")
        .when(F.regexp_count(text, F.lit("[0-9]+")) * 20 >= words, "figures")
        .when(without("?") * 50 >= words, "questions")
        .otherwise("prose")
    )


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def _targets(cells: DataFrame, dim: str, cfg: MixConfig) -> DataFrame:
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    given = cfg.targets.get(dim)
    if given:
        named = F.coalesce(*(F.when(F.col(dim) == F.lit(value), F.lit(float(share))) for value, share in given.items()))
        sums = own.agg(F.sum(named).alias("named"), F.sum(F.when(named.isNull(), F.col("t"))).alias("others")).first()
        rest = max(1.0 - (sums["named"] or 0.0), 0.0)
        share = F.coalesce(named, F.lit(rest / float(sums["others"] or 1)) * F.col("t"))
    else:
        share = F.pow(F.col("t").cast("double"), F.lit(cfg.power[dim]))
    own = stored(own.select(dim, share.alias("share")), f"targets-{dim}")
    total = own.agg(F.sum("share")).first()[0] or 1.0
    return own.select(dim, (F.col("share") / F.lit(total)).alias(f"{dim}_target"))


def deviation(cells: DataFrame) -> float:
    """The greatest difference between a value's share of the weights and its target."""
    total = cells.agg(F.sum("weight")).first()[0] or 1.0
    per_value = [cells.groupBy(dim, f"{dim}_target").agg(F.abs(F.sum("weight") / total - F.col(f"{dim}_target")).alias("d")).select("d") for dim in DIMENSIONS]
    return per_value[0].union(per_value[1]).union(per_value[2]).agg(F.max("d")).first()[0] or 0.0


def rake(cells: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: shares that sum to 1 and follow every dimension's targets.

    Where cells are missing, no weights may reach all targets; then the fit of the last sweep counts, or with strict a
    ValueError says how far it is off.
    """
    out = cells
    for dim in DIMENSIONS:
        out = out.join(_targets(cells, dim, cfg), dim)
    out = out.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(cfg.rounds):
        for _ in range(cfg.sweeps):
            for dim in DIMENSIONS:
                out = out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"{dim}_target"), F.sum("weight").over(Window.partitionBy(dim))), F.lit(0.0)))
        out = stored(out, "raked")
        off = deviation(out)
        if off <= cfg.tolerance:
            return out
    if cfg.strict:
        raise ValueError(f"the marginals stay {off:.2g} off their targets after {cfg.rounds * cfg.sweeps} sweeps")
    return out


def calibrated(cells: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """cells with probability: at most 1, expected tokens = keep of all, in proportion to the weights where cells suffice."""
    raked = rake(cells, cfg)
    total = raked.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w")).first()
    if not total["t"] or not total["w"]:
        return raked.withColumn("probability", F.lit(0.0))
    scale = cfg.keep * total["t"] / total["w"]
    for _ in range(cfg.fills):
        full = F.col("weight") * scale >= F.col("tokens")
        got = raked.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not got["full"] or not got["free"]:
            break
        before, scale = scale, (cfg.keep * total["t"] - got["full"]) / got["free"]
        if scale == before:
            break
    return raked.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("weight") * scale / F.col("tokens")), 6))


def weigh(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """docs with mix_tokens, mix_topic, mix_probability, mix_kept.

    Columns of these names are replaced. Null sources and languages are a category of their own. Rows without doc_id draw like the id ''. Repeated rows draw
    alike. An empty table stays empty.
    """
    ship(docs.sparkSession)
    keyed = docs.withColumn("mix_tokens", word_count(F.col("text"))).withColumn("mix_topic", content_topic(F.coalesce("text", F.lit("")), F.col("mix_tokens")))
    null = F.lit("(null)")
    named = keyed.select(F.coalesce("source", null).alias("source"), F.coalesce("lang", null).alias("lang"), F.col("mix_topic").alias("topic"), "mix_tokens")
    cells = stored(named.groupBy(*DIMENSIONS).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    rated = stored(calibrated(cells, cfg).select(*(F.col(d).alias(f"mix_cell_{d}") for d in DIMENSIONS), F.col("probability").alias("mix_probability")), "cell-rates")
    if rated.count() <= cfg.broadcast_cells:
        rated = F.broadcast(rated)
    on = (F.coalesce("source", null) == F.col("mix_cell_source")) & (F.coalesce("lang", null) == F.col("mix_cell_lang")) & (F.col("mix_topic") == F.col("mix_cell_topic"))
    out = keyed.join(rated, on).drop(*(f"mix_cell_{d}" for d in DIMENSIONS))
    return out.withColumn("mix_kept", draw(F.col("doc_id"), cfg.seed) < F.col("mix_probability"))


def sample(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The sampled rows of docs, with its columns, whatever their names."""
    held = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("mix_row"))
    return weigh(held, cfg).where("mix_kept").select("mix_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, topic, n_tokens, probability, kept of every document."""
    docs = weigh(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return docs.select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))


def sql(cfg: MixConfig = MixConfig()) -> str:
    """The rows of op1_mix_sources as DuckDB SQL, for targets that follow power."""
    signs = " + ".join(f"(len(text) - len(replace(text, '{c}', '')))" for c in "{;=|<")
    steps = [
        "d as (select doc_id, coalesce(source, '(null)') as source, coalesce(lang, '(null)') as lang, coalesce(text, '') as text,"
        " greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')), 1) as n_tokens from documents)",
        "k as (select doc_id, source, lang, n_tokens, case when contains(text, 'licen') or contains(text, 'Licen') or contains(text, 'opyright') then 'legal'"
        f" when ({signs}) * 10 >= n_tokens then 'code' when len(regexp_extract_all(text, '[0-9]+')) * 20 >= n_tokens then 'figures'"
        " when (len(text) - len(replace(text, '?', ''))) * 50 >= n_tokens then 'questions' else 'prose' end as topic from d)",
        "c as (select source, lang, topic, sum(n_tokens)::bigint as tokens from k group by all)",
    ]
    for dim in DIMENSIONS:
        steps.append(f"t_{dim} as (select {dim}, pow(sum(tokens)::double, {cfg.power[dim]}) / sum(pow(sum(tokens)::double, {cfg.power[dim]})) over () as target from c group by {dim})")
    steps.append("w0 as materialized (select c.*, tokens::double as weight, t_source.target as ts, t_lang.target as tl, t_topic.target as tt from c join t_source using (source) join t_lang using (lang) join t_topic using (topic))")
    n = 0
    for k in range(cfg.rounds):
        # Once the marginals are near enough, the weights stay.
        off = "greatest(" + ", ".join(f"abs(sum(weight) over (partition by {dim}) / sum(weight) over () - {t})" for dim, t in zip(DIMENSIONS, ("ts", "tl", "tt"), strict=True)) + ")"
        steps.append("o0 as (select 9.0 as off)" if k == 0 else f"o{k} as (select max(off) as off from (select {off} as off from w{n}))")
        for _ in range(cfg.sweeps):
            for dim, t in zip(DIMENSIONS, ("ts", "tl", "tt"), strict=True):
                steps.append(f"w{n + 1} as materialized (select * replace (case when (select off from o{k}) <= {cfg.tolerance} then weight else weight * {t} / sum(weight) over (partition by {dim}) end as weight) from w{n})")
                n += 1
    steps.append(f"s0 as (select {cfg.keep} * sum(tokens) / sum(weight) as scale, sum(tokens) as total from w{n})")
    for i in range(cfg.fills):
        steps.append(
            f"s{i + 1} as (select case when full_t is null or free_w is null then scale else ({cfg.keep} * total - full_t) / free_w end as scale, total from"
            f" (select any_value(scale) as scale, any_value(total) as total, sum(tokens) filter (weight * scale >= tokens) as full_t, sum(weight) filter (weight * scale < tokens) as free_w from w{n}, s{i}))"
        )
    steps.append(f"r as (select source, lang, topic, round(least(1.0, weight * scale / tokens), 6) as probability from w{n}, s{cfg.fills})")
    return (
        "with " + ", ".join(steps) + " select doc_id, topic, n_tokens::bigint as n_tokens, probability,"
        f" ('0x' || substr(md5('{cfg.seed}:' || doc_id::varchar), 1, 8))::bigint / 4294967296.0 < probability as kept from k join r using (source, lang, topic)"
    )
