"""Column-level data quality profile per load, of columns of any type.

value_counts   one row a (column, load, distinct value) with its count: the only shuffle of the data's size
expressions    regular expressions of each column, induced by minimum description length over its distinct values
coverage       rows of each load under each expression, against the load before
statistics     rows, nulls, range, distinct values, exact median of each (column, load)
findings       the loads that are out of order

Everything is counted; nothing is sampled.  A hot load or value is pre-aggregated by value before the shuffle; the
exact median narrows down a range of values until it holds few, so that no load is sorted in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.session import written

#: Cells a range is cut into, and the distinct values of a cell that are sorted in one task.
BINS, SORTED = 256, 65_536
#: Bits of one token of an expression, of a length in it, and of a character of any kind.
TOKEN_BITS, LENGTH_BITS, CHAR_BITS = 8.0, 4.0, math.log2(95)
#: Whole numbers beyond it are not told apart as doubles; they are counted by their text.
EXACT = 1 << 53


@dataclass(frozen=True)
class Profiled:
    """A column to profile: valid range with ends, and the largest shift of the median between loads."""

    name: str
    low: float = -math.inf
    high: float = math.inf
    shift: float = math.inf
    whole: bool = False


def _value_and_text(df: DataFrame, name: str) -> Column:
    """A column as struct (column_name, value double, text): numbers and times by value, everything else by text."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    none = F.lit(None)
    if isinstance(kind, T.FloatType | T.DoubleType):
        value, text = F.when(~F.isnan(c), c.cast("double") + 0.0), none.cast("string")
    elif isinstance(kind, T.NumericType):
        value, text = c.cast("double"), F.when(F.abs(c.cast("double")) > EXACT, c.cast("string"))
    elif isinstance(kind, T.TimestampType):
        value, text = c.cast("double"), none.cast("string")
    elif isinstance(kind, T.TimestampNTZType | T.DateType):
        value, text = c.cast("timestamp").cast("double"), none.cast("string")
    elif isinstance(kind, T.BooleanType | T.StringType):
        value, text = none.cast("double"), c.cast("string")
    else:
        value, text = none.cast("double"), F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))
    return F.struct(F.lit(name).alias("column_name"), value.alias("value"), text.alias("text"))


def value_counts(df: DataFrame, load: str, columns: list[Profiled]) -> DataFrame:
    """(column_name, load_id, value double, text, n); rows without a load are left out.

    Numbers have a value, NaN counts as null, and whole numbers beyond 2 ** 53 have a text too; strings have a text only,
    and so have nested values, as JSON; times are seconds.
    """
    df = df.where(F.col(load).isNotNull())
    each = [_value_and_text(df, c.name) for c in columns]
    if len(each) == 1:
        long = df.select(F.col(load).alias("load_id"), each[0].alias("e")).select("e.column_name", "load_id", "e.value", "e.text")
    else:
        long = df.select(F.col(load).alias("load_id"), F.explode(F.array(*each)).alias("e")).select("e.column_name", "load_id", "e.value", "e.text")
    return long.groupBy("column_name", "load_id", "value", "text").agg(F.count(F.lit(1)).alias("n"))


_HELD = "value IS NOT NULL OR text IS NOT NULL"


def as_written(value: Column, text: Column) -> Column:
    return F.coalesce(text, text_of(value))


def text_of(value: Column) -> Column:
    """A number as written: whole numbers without a point."""
    return F.regexp_replace(value.cast("string"), "\\.0$", "")


def shape_of(text: Column) -> Column:
    """The text with digits as 9 and ASCII letters as a."""
    return F.translate(text, "012345678" + "ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz", "9" * 9 + "a" * 51)


def collapsed(shape: Column) -> Column:
    """Runs of one class as one token: 999.99 is 9+.9+."""
    return F.regexp_replace(F.regexp_replace(shape, "9+", "9+"), "a+", "a+")


def regex_of(shape: Column, exact: bool) -> Column:
    """The regular expression of a shape (of runs with their lengths, or of any length)."""
    escaped = F.regexp_replace(shape, "([.+*?()\\[\\]{}^$|\\\\])", "\\\\$1")
    one = (lambda s, c, cls: F.regexp_replace(s, c, cls)) if exact else (lambda s, c, cls: F.regexp_replace(s, f"{c}+", f"{cls}+"))
    # letters first: the class of digits has a letter
    return one(one(escaped, "a", "[A-Za-z]"), "9", "\\\\d")


def expressions(counts: DataFrame) -> DataFrame:
    """(column_name, loose, shape, regex, n_values, bits): the expressions with the shortest description.

    The candidates of a column form a tree: everything, collapsed shapes below it, exact shapes below those.
    A branch is kept whole if its own expression costs no more bits (expression and values under it) than the
    expressions chosen below; an expression that costs more than its values spelt out is dropped, and its values
    conform to none (to tell which expression a value is under costs the same either way, and is left out).  shape is
    null where the collapsed expression was chosen.  All distinct values count; an empty text is under none.
    """
    text = as_written(F.col("value"), F.col("text"))
    distinct = counts.where(_HELD).select("column_name", "value", "text").distinct().select("column_name", shape_of(text).alias("shape"))
    size, digits, letters = F.length("shape"), F.length("shape") - F.length(F.replace("shape", F.lit("9"), F.lit(""))), F.length("shape") - F.length(F.replace("shape", F.lit("a"), F.lit("")))
    leaf = distinct.where("shape <> ''").groupBy("column_name", "shape").agg(F.count(F.lit(1)).alias("m")).withColumn("loose", collapsed(F.col("shape")))
    runs = F.length(F.regexp_replace("loose", "\\+", ""))
    content = digits * math.log2(10) + letters * math.log2(52)
    # a run's length is told by about 2 log2 bits; taken at the mean run length
    run_bits = 2 * F.log2(1.0 + size / runs) + 1
    leaf = leaf.withColumns({"own": TOKEN_BITS * runs + LENGTH_BITS * runs + F.col("m") * content, "as_loose": F.col("m") * (content + runs * run_bits), "plain": F.col("m") * (size * CHAR_BITS + run_bits)})
    w1 = W.partitionBy("column_name", "loose")
    # the tree has as many rows as there are shapes, not values
    leaf = leaf.withColumn("cnt", F.sum("m").over(w1))
    leaf = leaf.withColumn("branch", F.col("m") * F.log2(F.col("cnt") / F.col("m")))
    leaf = leaf.withColumns({"loose_cost": F.sum("as_loose").over(w1) + TOKEN_BITS * runs, "split_cost": F.sum(F.col("own") + F.col("branch")).over(w1), "loose_plain": F.sum("plain").over(w1)})
    split = leaf.where("split_cost < loose_cost").select("column_name", "loose", "shape", F.col("m").alias("n_values"), (F.col("own") + F.col("branch")).alias("bits"), "plain")
    whole = leaf.where("split_cost >= loose_cost").groupBy("column_name", "loose").agg(F.lit(None).cast("string").alias("shape"), F.max("cnt").alias("n_values"), F.max("loose_cost").alias("bits"), F.max("loose_plain").alias("plain"))
    chosen = split.unionByName(whole.select(*split.columns)).where("bits < plain")
    regex = F.when(F.col("shape").isNotNull(), regex_of(F.col("shape"), True)).otherwise(regex_of(F.regexp_replace("loose", "\\+(?!$)|\\+$", ""), False))
    return chosen.select("column_name", "loose", "shape", regex.alias("regex"), "n_values", "bits")


def shaped_rows(counts: DataFrame, induced: DataFrame) -> DataFrame:
    """(column_name, load_id, shape_, regex, n): rows with a value of each load by shape and by the expression that
    holds them, null if none does."""
    rows = counts.where(_HELD).withColumn("shape_", shape_of(as_written(F.col("value"), F.col("text")))).groupBy("column_name", "load_id", "shape_").agg(F.sum("n").alias("n")).withColumn("loose_", collapsed(F.col("shape_")))
    e = induced.select(F.col("column_name").alias("c"), "loose", "shape", "regex")
    on = (F.col("column_name") == F.col("c")) & (F.col("loose_") == F.col("loose")) & (F.col("shape").isNull() | (F.col("shape") == F.col("shape_")))
    return rows.join(e, on, "left").select("column_name", "load_id", "shape_", "regex", "n")


def coverage(counts: DataFrame, induced: DataFrame) -> DataFrame:
    """(column_name, load_id, regex, n): rows with a value of each load under each expression; regex null: under none."""
    return shaped_rows(counts, induced).groupBy("column_name", "load_id", "regex").agg(F.sum("n").alias("n"))


def fraction_rows(counts: DataFrame, induced: DataFrame, columns: list[Profiled]) -> DataFrame:
    """(column_name, load_id, n_fraction): rows in range under an expression of numbers with more than digits.

    Rows under no expression are judged by their own shape.
    """
    inside = counts.where(F.col("value").between(_case(columns, "low"), _case(columns, "high")))
    whole = F.when(F.col("regex").isNotNull(), F.col("regex").rlike(r"^-?(\\d\+?)+$")).otherwise(F.col("shape_").rlike("^-?9+$"))
    return shaped_rows(inside, induced).groupBy("column_name", "load_id").agg(F.sum(F.when(whole, 0).otherwise(F.col("n"))).alias("n_fraction"))


def coverage_change(covered: DataFrame, loads: DataFrame) -> DataFrame:
    """(column_name, load_id, n_nonconforming, change): half the summed difference of the shares of all expressions
    between a load and the one before it; null if there is none before."""
    key = ["column_name", "load_id"]
    share = covered.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*key))).withColumn("regex", F.coalesce("regex", F.lit("")))
    before = loads.where("prev_load_id is not null").select("load_id", "prev_load_id").distinct()
    now = share.join(before, "load_id", "left").select(*key, "regex", "share", F.lit(0.0).alias("then_share"), F.when(F.col("regex") == "", F.col("n")).otherwise(0).alias("odd"))
    then = share.withColumnRenamed("load_id", "prev_load_id").join(before, "prev_load_id").select("column_name", "load_id", "regex", F.lit(0.0).alias("share"), F.col("share").alias("then_share"), F.lit(0).cast("bigint").alias("odd"))
    both = now.unionByName(then).groupBy(*key, "regex").agg(F.sum("share").alias("a"), F.sum("then_share").alias("b"), F.sum("odd").alias("odd"))
    out = both.groupBy(*key).agg(F.sum("odd").alias("n_nonconforming"), (F.sum(F.abs(F.col("a") - F.col("b"))) / 2).alias("change"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return out.where("a > 0").select(*key, "n_nonconforming", F.when(F.col("b") > 0, F.col("change")).alias("change"))


def _case(columns: list[Profiled], attribute: str) -> Column:
    return F.create_map(*[x for c in columns for x in (F.lit(c.name), F.lit(float(getattr(c, attribute))))])[F.col("column_name")]


def statistics(counts: DataFrame, columns: list[Profiled]) -> DataFrame:
    """A row a (column_name, load_id): n_rows, n_null, n_distinct, low, high, low_text, high_text, n_outside, n_inside,
    median.

    low and high are numbers, low_text and high_text those of values that have a text only.  n_inside counts the
    numbers in range; median is theirs (mean of the middle two), null if there are none.  Infinite values are outside.
    """
    value, n = F.col("value"), F.col("n")
    held = value.isNotNull() | F.col("text").isNotNull()
    finite = F.abs(value) < math.inf
    inside = F.coalesce(value.between(_case(columns, "low"), _case(columns, "high")) & finite, F.lit(False))
    words = F.when(value.isNull(), F.col("text"))
    base = counts.groupBy("column_name", "load_id").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(held, 0).otherwise(n)).alias("n_null"), F.count(F.when(held, 1)).alias("n_distinct"), F.min("value").alias("low"), F.max("value").alias("high"), F.min(words).alias("low_text"), F.max(words).alias("high_text"),
        F.sum(F.when(value.isNotNull() & ~inside, n).otherwise(0)).alias("n_outside"), F.sum(F.when(inside, n).otherwise(0)).alias("n_inside"),
        F.min(F.when(inside, value)).alias("__lo"), F.max(F.when(inside, value)).alias("__hi"),
    )
    base = written(base, "profile_base")  # one row a (column, load)
    return base.drop("__lo", "__hi").join(medians(counts.where(inside), base), ["column_name", "load_id"], "left")


def medians(inside: DataFrame, base: DataFrame) -> DataFrame:
    """(column_name, load_id, median) of finite values (column_name, load_id, value, n), exact.

    base: (column_name, load_id, n_inside, __lo, __hi) of the same values.  A middle rank is sought in the range of its
    load's values, cut into BINS cells; the cell that holds it, with the range of its own values, is cut again, until a
    cell has at most SORTED distinct values; only these are sorted.  One turn is enough but for loads of very many
    values or very uneven ones.
    """
    key = ["column_name", "load_id", "rank_no"]
    ranks = F.array(F.floor((F.col("n_inside") - 1) / 2), F.floor(F.col("n_inside") / 2))
    sought = base.where("n_inside > 0").select("column_name", "load_id", F.posexplode(ranks).alias("rank_no", "rank"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"))
    value = F.col("value")
    narrow = lambda t: inside.join(t, ["column_name", "load_id"]).where(value.between(F.col("lo"), F.col("hi")))
    while True:
        # halves, so that the width of no range overflows
        part = (value / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(part * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")
        cells = narrow(sought).withColumn("cell", cell).groupBy(*key, "rank", "cell").agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n_values"))
        upto = F.sum("n").over(W.partitionBy(*key).orderBy("cell"))
        found = cells.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        sought = written(found.select(*key, (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi", "n_values"), "medians")
        if not sought.where((F.col("n_values") > SORTED) & (F.col("hi") > F.col("lo"))).limit(1).count():
            break
        sought = sought.drop("n_values")
    upto = F.sum("n").over(W.partitionBy(*key).orderBy("value"))
    last = narrow(sought).groupBy(*key, "rank", "value").agg(F.sum("n").alias("n")).withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return last.groupBy("column_name", "load_id").agg((F.sum(value / 2)).alias("median"))


def findings(stats: DataFrame, forms: DataFrame, loads: DataFrame, columns: list[Profiled], null_share: float = 0.1, outside_share: float = 0.02, few: int = 3) -> DataFrame:
    """(column_name, load_id, finding): null_rate, out_of_range, constant, whole and shift of each load.

    stats and forms as statistics and fraction_rows give them; loads (load_id, prev_load_id).
    """
    before = loads.where("load_id is not null and prev_load_id is not null").select("load_id", "prev_load_id").distinct()
    then = stats.select("column_name", F.col("load_id").alias("prev_load_id"), F.col("median").alias("then")).where("then is not null")
    s = stats.join(before, "load_id", "left").join(then, ["column_name", "prev_load_id"], "left").join(forms, ["column_name", "load_id"], "left")
    values = F.col("n_rows") - F.col("n_null")
    whole = _case(columns, "whole") > 0
    kinds = F.array(
        F.when(F.col("n_null") > null_share * F.col("n_rows"), "null_rate"), F.when(F.col("n_outside") > outside_share * values, "out_of_range"), F.when((F.col("n_distinct") >= 1) & (F.col("n_distinct") < few), "constant"),
        F.when(whole & (F.col("n_inside") > 0) & (F.col("n_fraction") == 0), "whole"), F.when(F.abs(F.col("median") - F.col("then")) > _case(columns, "shift"), "shift"),
    )
    return s.select("column_name", "load_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("finding")).distinct()
