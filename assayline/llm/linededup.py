"""Line de-duplication by an exact set-similarity join, in DataFrame expressions.

A line is the set of its lower-case words. Words are ordered by rarity, known from
counts of word hashes in a fixed number of buckets, ties by hash; any one order makes
the prefix filter exact, a good one makes it fast. Lines of equal sets form a class,
named by its first line in the order of documents and lines. A line is removed where an
earlier line has a similar set: all lines of a class but its first, and the first too
where any class that begins earlier is similar. Whether one exists is all that removal
asks, so the result has removals, not the links between all variants of a line.

The join has three filters on top of the shared prefix word: sizes, positions, and
parity bitmaps, whose Hamming distance never exceeds the number of words that two sets
differ by. So that a large group of variants of one line does not meet itself in pairs,
classes are first compared with the earliest class of an equal minwise value; only
classes without a match so far ask the prefix join. A class that finds several
candidates is first verified with the one whose bitmap is nearest, then, where that
fails, with all others.

Words are compared by 64-bit hashes. Sets are taken as equal where size, least hash
and a 64-bit hash of the set agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.llm.shared import discard, stored
from assayline.sources.tables import ship, table

#: Buckets of the rarity counts: a bounded table, whatever the corpus.
BUCKETS = 1 << 17
#: Buckets whose counts are columns of one row: so few rows stay in the fast map of an aggregate, which has room for 65,536.
_BESIDE = 8
#: Sets of up to so many words have 64 parities, larger ones 128: those of a short set tell it from others well enough.
SHORT = 96
#: Columns that name a set of words.
SET = ("k1", "m1", "n")
#: A line's place: its document, and its number with the rank of its row among rows of that doc_id in the high bits.
AT = ("d", "l")
_ROW_BITS = 32
#: Hashes are written as they are: a dictionary of them costs more time than it saves room.
PLAIN = {"parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class LineConfig:
    """percent: least Jaccard similarity, in hundredths. broadcast_rows: rows (of a few numbers each) up to which a
    table of classes or ids is broadcast; beyond, Spark joins by shuffling."""

    percent: int = 80
    broadcast_rows: int = 1_000_000


def _small(df: DataFrame, cfg: LineConfig) -> DataFrame:
    return F.broadcast(df) if df.count() <= cfg.broadcast_rows else df


def _shift(a: Column | int, b: Column | int) -> Column:
    a = F.lit(a).cast("long") if isinstance(a, int) else a
    return F.call_function("shiftleft", a, F.lit(b) if isinstance(b, int) else b)


def _split(line: Column) -> Column:
    """Lower-case words, with empty ones between several blanks. Splitting by one character takes no pattern."""
    low = F.lower(line)
    for blank in "\t\x0b\f\r":
        low = F.replace(low, F.lit(blank), F.lit(" "))
    return F.split(low, " ")


def _hashes(line: Column) -> Column:
    """Distinct word hashes of a line, never null; the empty word's is left out."""
    return F.array_remove(F.array_distinct(F.transform(_split(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(BUCKETS - 1).cast("int")


def _rows(docs: DataFrame) -> DataFrame:
    """docs with line_base: 0, or where rows repeat a doc_id their rank by text, in the high bits of a line's number."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.take(1):
        return docs.withColumn("line_base", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text")) - 1
    return docs.withColumn("line_base", _shift(rank.cast("long"), _ROW_BITS))


def _lines(rows: DataFrame) -> DataFrame:
    real = rows.where("doc_id is not null and text is not null")
    return real.select(F.col("doc_id").cast("long").alias("d"), "line_base", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def rarity(sets: DataFrame) -> list[int]:
    """The level of each bucket of word hashes, by the number of lines with its words: BUCKETS numbers under 128, rarest least.
    sets: a column w of the word hashes of each line."""
    b = sets.select(F.explode("w").alias("w")).select(_bucket(F.col("w")).alias("b")).select(F.shiftright("b", _BESIDE.bit_length() - 1).alias("row"), F.col("b").bitwiseAND(_BESIDE - 1).alias("i"))
    counts = b.groupBy("row").agg(*(F.count_if(F.col("i") == i).alias(f"n{i}") for i in range(_BESIDE)))
    level = lambda n: F.when(F.col(n) > 0, F.least(F.floor(F.log2(n) * 4), F.lit(127))).otherwise(0).cast("int").alias(n)
    levels = [0] * BUCKETS
    for row, *some in counts.select("row", *(level(f"n{i}") for i in range(_BESIDE))).collect():  # at most BUCKETS / _BESIDE rows
        levels[row * _BESIDE : (row + 1) * _BESIDE] = some
    return levels


def _from_rarest(words: Column, levels: list[int]) -> Column:
    """Word hashes ordered by rarity, then hash; a word is its level and 56 bits of its hash."""
    table_ = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<long>")  # folded into one constant
    level = lambda h: F.coalesce(F.get(table_, _bucket(h)), F.lit(0).cast("long"))
    return F.sort_array(F.transform(words, lambda h: _shift(level(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _parity(words: Column, use: Column | None = None) -> Column:
    """64 bits: the parity of the number of words in each of 64 buckets; use: of one bit of each word, 1 where it counts."""
    bit = lambda h: _shift(F.lit(1).cast("long") if use is None else use(h), h.bitwiseAND(63).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h)))


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of sets of sizes a and b at the threshold."""
    return F.ceil((a + b) * percent / F.lit(100 + percent) - 1e-9)


def _distance(a: str, b: str) -> Column:
    """A lower bound of the number of words that two sets differ by: unequal bits of 128 parities, or of 64 if one set is short."""
    whole, half = F.col(f"{a}.p").bitwiseXOR(F.col(f"{b}.p")), F.col(f"{a}.q").bitwiseXOR(F.col(f"{b}.q"))
    return F.coalesce(F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half)), F.bit_count(whole))


def _compatible(a: str, b: str, percent: int) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
    return sizes & (_distance(a, b) <= na + nb - 2 * _needed(na, nb, percent))


def _later(a: str, b: str) -> Column:
    return (F.col(f"{a}.d") > F.col(f"{b}.d")) | ((F.col(f"{a}.d") == F.col(f"{b}.d")) & (F.col(f"{a}.l") > F.col(f"{b}.l")))


def _word_sets(pairs: DataFrame, rows: DataFrame, cfg: LineConfig) -> DataFrame:
    """(d, l, w): the word hashes of all lines that pairs (d, l, ed, el) name."""
    ids = pairs.select("d", "l").union(pairs.select("ed", "el")).distinct()
    per_doc = stored(ids.groupBy("d").agg(F.collect_list("l").alias("ls")), "lines-wanted")  # at most a document's lines
    real = rows.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("d"), "line_base", "text")
    parts = real.join(_small(per_doc, cfg), "d").select("d", "line_base", F.split("text", "\n").alias("lines"), F.explode("ls").alias("l"))
    own = (F.col("l") - F.col("line_base")).cast("int")
    parts = parts.where((F.shiftright("l", _ROW_BITS) == F.shiftright("line_base", _ROW_BITS)) & (own < F.size("lines")))
    sets = stored(parts.select("d", "l", _hashes(F.get("lines", own)).alias("w")), "line-words")
    discard(per_doc)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, cfg: LineConfig) -> DataFrame:
    """(d, l) of those of pairs whose word sets reach the threshold."""
    a, b = sets.withColumnRenamed("w", "wa"), sets.select(F.col("d").alias("ed"), F.col("l").alias("el"), F.col("w").alias("wb"))
    both = pairs.join(a, ["d", "l"]).join(b, ["ed", "el"]).withColumn("o", F.size(F.array_intersect("wa", "wb")))
    return stored(both.where(F.col("o") * 100 >= (F.size("wa") + F.size("wb") - F.col("o")) * cfg.percent).select("d", "l").distinct(), "lines-matched")


def _candidates(classes: DataFrame, cfg: LineConfig) -> DataFrame:
    """(d, l, ed, el, apart): classes (d, l, n, p, q, prefix, asks) that ask, and earlier ones that may be similar."""
    posted = lambda prefix: classes.select(*AT, "n", "p", "q", "asks", F.posexplode(prefix).alias("pos", "w"))
    short = (F.col("n") - _needed(F.col("n"), F.col("n"), cfg.percent) + 1).cast("int")
    a, b = posted(F.col("prefix")).alias("a"), posted(F.slice("prefix", F.lit(1), short)).alias("b")
    na, nb, later = F.col("a.n"), F.col("b.n"), _later("a", "b")
    once = (na > nb) | later  # sets of one size probe each other
    sizes = (na >= nb) & (nb * 100 >= na * cfg.percent)  # most pairs end here, so it is asked first
    asking = F.when(later, F.col("a.asks")).otherwise(F.col("b.asks")) == 1
    room = F.least(na - F.col("a.pos"), nb - F.col("b.pos")) >= _needed(na, nb, cfg.percent)
    both = a.join(b, F.col("a.w") == F.col("b.w")).where(sizes & once & asking & room & _compatible("a", "b", cfg.percent))
    ends = [F.when(later, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(name) for x, y, names in (("a", "b", AT), ("b", "a", ("ed", "el"))) for c, name in zip(AT, names, strict=True)]
    return both.select(*ends, _distance("a", "b").alias("apart")).groupBy(*AT, "ed", "el").agg(F.min("apart").alias("apart"))


def removals(docs: DataFrame, cfg: LineConfig = LineConfig()) -> tuple[DataFrame, DataFrame]:
    """(docs with line_base, (d, gone_base, removed_lines) of its rows that lose lines)."""
    ship(docs.sparkSession)
    rows = _rows(docs)
    # Words are split and hashed once, for their counts and for their sets. The executors keep them, as arrays, which Parquet takes apart.
    hashed = _lines(rows).select("d", (F.col("line_base") + F.col("line_no")).alias("l"), _hashes(F.col("line")).alias("w")).persist(StorageLevel.DISK_ONLY)
    levels = rarity(hashed)
    lines = hashed.select("d", "l", F.size("w").alias("n"), F.array_min("w").alias("m1"), F.array_max("w").alias("m2"), _from_rarest(F.col("w"), levels).alias("o"), _parity(F.col("w")).alias("p"), F.when(F.size("w") > SHORT, _parity(F.col("w"), lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(1))).alias("q"))
    size = F.col("n") - F.ceil(F.col("n") * cfg.percent / F.lit(100) - 1e-9).cast("int") + 1
    prefix = F.transform(F.slice("o", F.lit(1), size), lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int"))
    lines = stored(lines.select("d", "l", "n", "m1", "m2", F.xxhash64("o").alias("k1"), "p", "q", prefix.alias("prefix")).where("n > 0"), "lines", **PLAIN)
    hashed.unpersist()

    # Classes: the first line of each set.
    first = lines.groupBy(*SET).agg(F.min(F.struct("d", "l")).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1").select(*SET, F.col("f.d").alias("fd"), F.col("f.l").alias("fl"))
    first = stored(first, "line-firsts")
    firsts = _small(first, cfg)
    placed = lines.join(firsts, list(SET), "left")
    again = F.col("fd").isNotNull() & ((F.col("d") != F.col("fd")) | (F.col("l") != F.col("fl")))
    classes = placed.where(~again)

    # A class of the earliest document with an equal minwise value, where it is similar.
    by_min = classes.select(F.explode(F.array("m1", "m2")).alias("m"), "d", "l", "n", "p", "q")
    # Numbers only, so that it is hashed, not sorted. Of classes of one document it may be any; all pick the same row.
    heads = by_min.groupBy("m").agg(F.min("d").alias("d"), *(F.min_by(c, "d").alias(c) for c in ("l", "n", "p", "q")), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    heads = stored(heads, "line-heads")
    tried = by_min.alias("a").join(_small(heads, cfg).alias("h"), F.col("a.m") == F.col("h.m")).where(_later("a", "h") & _compatible("a", "h", cfg.percent))
    tried = tried.select("a.d", "a.l", F.col("h.d").alias("ed"), F.col("h.l").alias("el")).distinct()
    tried = stored(tried, "line-tries")
    sets = _word_sets(tried, rows, cfg)
    matched = _verified(tried, sets, cfg)
    discard(heads, tried, sets)

    # Prefix join. Sets of which the other is no smaller share a word in a shorter prefix, so only that of each is indexed; all prefixes probe.
    asks = F.when(F.col("matched").isNull(), 1).otherwise(0)
    known = classes.select(*AT, "n", "p", "q", "prefix").join(_small(matched.withColumn("matched", F.lit(True)), cfg), list(AT), "left")
    found = _candidates(known.select(*AT, "n", "p", "q", "prefix", asks.alias("asks")), cfg)
    found = stored(found, "line-candidates")
    nearest = found.groupBy(*AT).agg(F.min(F.struct("apart", "ed", "el")).alias("e")).select(*AT, F.col("e.ed").alias("ed"), F.col("e.el").alias("el"))
    nearest = stored(nearest, "line-nearest")
    sets = _word_sets(found, rows, cfg)
    good = _verified(nearest, sets, cfg)
    rest = found.select(*AT, "ed", "el").join(_small(good, cfg), list(AT), "left_anti").join(nearest, [*AT, "ed", "el"], "left_anti")
    rest = stored(rest, "line-rest")
    late = matched.union(good).union(_verified(rest, sets, cfg))

    gone = placed.where(again).select(*AT).union(late)
    base = _shift(F.shiftright("l", _ROW_BITS), _ROW_BITS)
    gone = gone.groupBy("d", base.alias("gone_base")).agg(F.array_sort(F.collect_list((F.col("l") - base).cast("int"))).alias("removed_lines"))
    gone = stored(gone, "lines-gone")
    discard(lines, first, found, nearest, rest, matched, good, sets)
    return rows, gone


def mark_lines(docs: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines) of every row of docs (doc_id, text); line numbers count from 0.

    A line is removed where an earlier line, by doc_id and line number, has a similar set of words. Lines without words
    are kept. Null text has no lines; an empty text has one. Rows without doc_id take no part and keep all. Rows that
    repeat a doc_id count as documents of their own, in the order of their texts.
    """
    rows, gone = removals(docs.select("doc_id", "text"), cfg)
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counted = rows.select("doc_id", "line_base", F.coalesce(n_lines, F.lit(0)).alias("n_lines"))
    out = counted.join(_small(gone, cfg), (F.col("doc_id") == F.col("d")) & (F.col("line_base") == F.col("gone_base")), "left")
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed_lines"))


def drop_lines(docs: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """docs with repeated lines taken out of text; all columns, whatever their names."""
    held = docs.select("doc_id", "text", F.struct("*").alias("line_row"))
    rows, gone = removals(held, cfg)
    marks = _small(gone, cfg).select(F.col("d"), F.col("gone_base"), F.map_from_arrays("removed_lines", F.transform("removed_lines", lambda i: F.lit(True))).alias("gone"))
    out = rows.join(marks, (F.col("doc_id") == F.col("d")) & (F.col("line_base") == F.col("gone_base")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: F.element_at("gone", i).isNull()), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    return out.select(F.col("line_row").withField("text", text).alias("r")).select("r.*")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines of every document."""
    return mark_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
