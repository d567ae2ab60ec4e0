"""Benchmark decontamination by templates, so that questions with changed numbers or names are found too.

Texts become sequences of tokens in which numbers, names and units are typed
placeholders; a run of name words is one. Only texts that hold a run of plain words
from some window of the benchmark, its anchor, are looked at that closely, or, where a
window has no plain word, as many numbers in a row as it has. Windows of template tokens
of documents are hash-joined with those of the benchmark; each alignment that shares a window is then compared token by token over the
whole item. Placeholders must be filled consistently: one value of the item always
stands for one value of the document; different values may become equal. Whether an
item's first word looks like a name depends on what precedes it in the document, so it
also agrees by its word alone. Items too short for a template are found by their exact
sequence of words. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.shared import stored
from assayline.sources.tables import ship, table

#: Words that count as units after a number or alone.
UNITS = (
    "%", "$", "€", "£", "°", "km", "m", "cm", "mm", "kg", "g", "mg", "lb", "lbs", "oz", "mile", "miles", "meter",
    "meters", "metre", "metres", "foot", "feet", "inch", "inches", "litre", "litres", "liter", "liters", "ml", "hour",
    "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year",
    "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "pound", "pounds", "degree", "degrees", "mph",
    "kmh", "percent",
)

NUMBER, NAME, UNIT = "\u0002#", "\u0002@", "\u0002u"
_NAME_MARK = "\u0001"
#: Lengths of the runs of plain words that choose the texts to look at, tried in this order.
ANCHORS = (4, 2, 1)


@dataclass(frozen=True)
class TemplateConfig:
    """window: template tokens of a window; shorter items are one window. min_tokens: items below this must occur word by
    word, as their templates say nothing. cover: least share of an item's tokens that an alignment must match.
    broadcast_windows: benchmark windows up to which they are broadcast; beyond, they are shuffled."""

    window: int = 8
    min_tokens: int = 5
    cover: float = 0.6
    broadcast_windows: int = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case tokens; a capitalised word that does not begin a sentence or line carries a mark, and a run of such
    words is one token, so that names of one and of several words fill the same slot."""
    text = F.coalesce(text, F.lit(""))
    clean = F.when(text.contains("\u0001") | text.contains("\u0002"), F.regexp_replace(text, "[\u0001\u0002]", " ")).otherwise(text)
    named = F.regexp_replace(clean, r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;:)'\"’] {1,3})", _NAME_MARK)
    name = _NAME_MARK + r"\p{L}++(?: {1,3}" + _NAME_MARK + r"\p{L}++)*+"
    found = F.regexp_extract_all(F.lower(named), F.lit(name + r"|\p{L}++|\p{N}++(?:[.,]\p{N}++)*+|[%$€£°]"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.contains("  "), F.regexp_replace(t, " +", " ")).otherwise(t))


def template(found: Column) -> Column:
    """Tokens with their slots as placeholders."""
    return F.transform(
        found,
        lambda t: F.when(t.startswith(_NAME_MARK), F.lit(NAME)).when(t.rlike(r"^\p{N}"), F.lit(NUMBER)).when(t.isin(*UNITS), F.lit(UNIT)).otherwise(t),
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _bare(token: Column) -> Column:
    """The token without a name's marks."""
    return F.translate(token, _NAME_MARK, "")


def _single(found: Column) -> Column:
    """Tokens without marks, names word by word."""
    return F.when(F.size(found) > 0, F.split(F.array_join(F.transform(found, _bare), " "), " ")).otherwise(F.array().cast("array<string>"))


def _grams(words: Column, n: int) -> Column:
    """struct(n, size, h) of each run of n words, none of them null: its length in characters and its hash."""
    runs = F.filter(F.transform(words, lambda w, i: F.slice(words, i + 1, n)), lambda r: (F.size(r) == n) & ~F.exists(r, lambda w: w.isNull()))
    return F.transform(runs, lambda r: F.struct(F.lit(n).alias("n"), F.length(F.array_join(r, " ")).alias("size"), F.xxhash64(F.lit(n), r).alias("h")))


def _anchor(own: Column, typed: Column) -> Column:
    """struct(n, size, h) of the longest run of plain words of a window (own: its bare tokens, typed: its templates), of
    one of ANCHORS lengths, or null: a text without that run can't hold the window."""
    plain = F.zip_with(own, typed, lambda w, t: F.when((w == t) & w.rlike(r"^\p{L}+$"), w))
    return F.coalesce(*(F.array_max(_grams(plain, n)) for n in ANCHORS))


def _slot_pattern(numbers: int) -> str:
    """What a text has where it holds so many number tokens in a row, or at 0 a unit."""
    if not numbers:
        words = "|".join(u for u in UNITS if u.isalpha())
        return rf"(?i)[%$€£°]|(?<!\p{{L}})(?:{words})(?!\p{{L}})"
    return r"\p{N}++(?:[^\p{L}\p{N}]++\p{N}++){%d}" % (numbers - 1)


def _candidates(rows: DataFrame, words: DataFrame, cfg: TemplateConfig) -> DataFrame:
    """Those of rows whose text holds the anchor of some window, or, for windows without a plain word, as many numbers
    in a row as the one with fewest of them (without numbers, some unit)."""
    it, tt = F.transform("it", _bare), F.when(F.col("short"), F.col("it")).otherwise(F.col("tt"))
    k = F.when(F.col("short"), F.size("it")).otherwise(F.least(F.size("it"), F.lit(cfg.window)))
    parts = words.select(it.alias("own"), tt.alias("typed"), k.alias("k"), F.explode(F.sequence(F.lit(1), F.size("it") - k + 1)).alias("i"))
    own = F.slice("own", F.col("i"), F.col("k"))
    anchor = _anchor(own, F.slice("typed", F.col("i"), F.col("k")))
    digits = F.array_join(F.transform(own, lambda w: F.when(w.rlike(r"^\p{N}"), "1").otherwise("0")), "")
    in_row = F.array_max(F.transform(F.split(digits, "0"), F.length))
    anchors = stored(parts.select(anchor.alias("a"), in_row.alias("numbers")).select("a.n", "a.h", F.when(F.col("a").isNull(), F.col("numbers")).alias("numbers")).distinct(), "anchors")
    lengths = sorted(r["n"] for r in anchors.where("n is not null").select("n").distinct().collect())  # at most those of ANCHORS
    fewest = anchors.agg(F.min("numbers")).first()[0]
    anchors = anchors.where("h is not null").select("h").distinct()
    if anchors.count() <= cfg.broadcast_windows:
        anchors = F.broadcast(anchors)
    letters = F.split(F.lower("text"), r"\P{L}+")

    def hashes(ws: Column, n: int) -> Column:
        return F.transform(ws, lambda w, i: F.xxhash64(F.lit(n), F.slice(ws, i + 1, n)))

    held = rows.select("doc_id", "text_key").limit(0)
    if lengths:
        pairs = _bound(letters, lambda ws: F.flatten(F.array(*(hashes(ws, n) for n in lengths))))
        held = rows.select("doc_id", "text_key", F.explode(pairs).alias("h")).join(anchors, "h", "left_semi").select("doc_id", "text_key")
    if fewest is not None:
        held = held.union(rows.where(F.col("text").rlike(_slot_pattern(fewest))).select("doc_id", "text_key"))
    held = stored(held.distinct(), "candidates")
    return rows.join(F.broadcast(held) if held.count() <= cfg.broadcast_windows else held, ["doc_id", "text_key"], "left_semi")


def _windows(df: DataFrame, keys: list[str], found: Column, sizes: list[int], exact_sizes: list[int]) -> DataFrame:
    """keys, pos and hash h of each window over tokens: of templates in sizes, of single words in exact_sizes.

    A template window that begins with a name is there twice, with its placeholder and with the bare word.
    """
    none = F.array().cast("array<struct<pos:int,h:bigint>>")

    def starts(h: Column, k: int) -> Column:
        return F.sequence(F.lit(1), F.greatest(F.size(h) - k + 1, F.lit(1)))

    def of_size(th: Column, names: Column, k: int) -> Column:
        some = F.transform(starts(th, k), lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.lit(k), F.element_at(th, i), F.slice(th, i + 1, k - 1)).alias("h")))
        named = F.filter(starts(th, k), lambda i: F.element_at(names, i).isNotNull())
        more = F.transform(named, lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.lit(k), F.element_at(names, i), F.slice(th, i + 1, k - 1)).alias("h")))
        return F.when(F.size(th) >= k, F.concat(some, more)).otherwise(none)

    def of_words(wh: Column, k: int) -> Column:
        some = F.transform(starts(wh, k), lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.lit(-k), F.slice(wh, i, k)).alias("h")))
        return F.when(F.size(wh) >= k, some).otherwise(none)

    def of_tokens(t: Column) -> Column:
        th = F.transform(template(t), lambda x: F.xxhash64(x))
        names = F.transform(t, lambda x: F.when(x.startswith(_NAME_MARK), F.xxhash64(_bare(x))))
        typed = [_bound(F.struct(th.alias("th"), names.alias("names")), lambda b: F.flatten(F.array(*(of_size(b["th"], b["names"], k) for k in sizes))))] if sizes else []
        plain = [_bound(F.transform(_single(t), lambda x: F.xxhash64(x)), lambda wh: F.flatten(F.array(*(of_words(wh, k) for k in exact_sizes))))] if exact_sizes else []
        return F.concat(*typed, *plain)

    return df.select(*keys, F.explode(_bound(found, of_tokens)).alias("w")).select(*keys, "w.pos", "w.h")


def contaminated(docs: DataFrame, items: DataFrame, cfg: TemplateConfig = TemplateConfig()) -> DataFrame:
    """(doc_id, item_id, item_tokens, matched, slots, changed, kind): pairs of document and item that it contains.

    matched: item tokens that agree in the best alignment; slots: placeholders among them, changed: those whose value
    differs. kind: 'exact' where no value differs, else 'reparameterised'. Items of under min_tokens tokens are only found
    exactly. Of alignments of one document and item the one with most agreeing tokens counts, then fewest changes. Rows
    without id or text, and items without a token, take no part. Repeated rows give one result, and texts under one
    doc_id count together. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    words = items.where("item_id is not null and text is not null").select("item_id", "text", tokens(F.col("text")).alias("it"))
    # A name of several words that begins an item is one token where the item follows other words.
    inside = words.where(F.get("it", F.lit(1)).startswith(_NAME_MARK)).select("item_id", "text", tokens(F.concat(F.lit(", "), "text")).alias("it"))
    words = words.where(F.size("it") > 0).union(inside).drop("text")
    words = words.withColumn("short", F.size("it") < cfg.min_tokens).withColumn("it", F.when(F.col("short"), _single(F.col("it"))).otherwise(F.col("it")))
    words = words.distinct().withColumn("tt", template(F.col("it")))
    words = stored(words.withColumn("item_key", F.xxhash64("item_id", "it")), "benchmark-items")
    kinds = words.select("short", F.when(F.col("short"), F.size("it")).otherwise(F.least(F.size("it"), F.lit(cfg.window))).alias("k")).distinct().collect()  # at most window + min_tokens values
    sizes, exact_sizes = (sorted(r["k"] for r in kinds if r["short"] == short) for short in (False, True))
    if not kinds:
        return spark.createDataFrame([], "doc_id long, item_id long, item_tokens int, matched int, slots int, changed int, kind string")
    per_item = None
    for k, exact in [(k, False) for k in sizes] + [(k, True) for k in exact_sizes]:
        own = words.where((F.col("short") == exact) & ((F.size("it") if exact else F.least(F.size("it"), F.lit(cfg.window))) == k))
        one = _windows(own, ["item_key", "short"], F.col("it"), [] if exact else [k], [k] if exact else [])
        per_item = one if per_item is None else per_item.union(one)
    per_item = stored(per_item.withColumnRenamed("pos", "item_pos").distinct(), "benchmark-windows")
    bounded = per_item.count() <= cfg.broadcast_windows

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    texts = _candidates(rows, words, cfg).select("doc_id", "text_key", tokens(F.col("text")).alias("dt"))
    texts = stored(texts.withColumn("dw", _single(F.col("dt"))), "candidate-tokens")  # repeated rows still among them
    seen = _windows(texts, ["doc_id", "text_key"], F.col("dt"), sizes, exact_sizes).join(F.broadcast(per_item) if bounded else per_item, "h")
    shift = F.col("pos") - F.col("item_pos")
    seen = seen.select("doc_id", "text_key", "item_key", shift.alias("shift"), F.when(~F.col("short"), shift).alias("place"))
    at = stored(seen.groupBy("doc_id", "text_key", "item_key", "place").agg(F.min("shift").alias("shift")).drop("place"), "alignments")  # one of an exact sequence's places is enough

    hit = at.select("doc_id", "text_key").distinct()
    hit = F.broadcast(hit) if hit.count() <= cfg.broadcast_windows else hit
    texts = texts.join(hit, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    both = at.join(texts, ["doc_id", "text_key"]).join(words.select("item_key", "item_id", "it", "tt", "short"), "item_key")
    n = F.size("it")

    def facing(i: Column) -> Column:
        at_ = F.col("shift") + i
        word = F.when((at_ >= 0) & (at_ < F.size("dw")), F.get("dw", at_))
        own = F.when((at_ >= 0) & (at_ < F.size("dt")), F.get("dt", at_))
        by_word = F.when(_bare(own) == _bare(F.get("it", i)), F.get("it", i))
        return F.when(F.col("short"), F.when(word == F.get("it", i), word)).when(i == 0, F.coalesce(by_word, own)).otherwise(own)

    aligned = F.transform(F.sequence(F.lit(0), n - 1), facing)
    both = stored(both.select("doc_id", "item_id", "it", "tt", "short", aligned.alias("seen")), "aligned").withColumn("seen_t", template(F.col("seen")))
    pairs = F.zip_with(F.arrays_zip("it", "tt"), F.arrays_zip("seen", "seen_t"), lambda a, b: F.when(a["tt"] == b["seen_t"], F.struct(a["tt"].alias("t"), a["it"].alias("a"), b["seen"].alias("b"))))
    both = stored(both.select("doc_id", "item_id", "short", n.alias("item_tokens"), F.filter(pairs, lambda p: p.isNotNull()).alias("same")), "agreeing")
    slots = F.filter("same", lambda p: p["t"].isin(NUMBER, NAME, UNIT))
    both = both.withColumn("slot", slots).withColumn("fills", F.array_distinct("slot"))
    one_value = F.size(F.array_distinct(F.transform("fills", lambda p: F.struct(p["t"], p["a"])))) == F.size("fills")
    least = F.when(F.col("short"), F.col("item_tokens")).otherwise(F.col("item_tokens") * cfg.cover)
    found = both.where(one_value & (F.size("same") >= least)).select(
        "doc_id", "item_id", "item_tokens", F.size("same").alias("matched"), F.size("slot").alias("slots"), F.size(F.filter("slot", lambda p: p["a"] != p["b"])).alias("changed"),
    )
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("changed")).alias("kept"), "slots", "item_tokens")).alias("m"))
    changed = -F.col("m.kept")
    return best.select("doc_id", "item_id", "m.item_tokens", "m.matched", "m.slots", changed.alias("changed"), F.when(changed == 0, "exact").otherwise("reparameterised").alias("kind"))


def drop_contaminated(docs: DataFrame, items: DataFrame, cfg: TemplateConfig = TemplateConfig()) -> DataFrame:
    """docs without those that contain an item; rows without doc_id stay."""
    return docs.join(contaminated(docs, items, cfg).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of document and benchmark item that the document contains."""
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
