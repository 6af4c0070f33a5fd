"""Far too many small files: consolidate them into few of even size, each record once.

plan_layout    each record once with its true directory, its Hilbert code and its target file
write_layout   the files themselves, one a (directory, file)
digests        order-free digests of a table, to compare source and destination
consolidate    all of these; the written table, with the file each record was taken from
audit_files    what each source file is: empty, repeat, small, misfiled, by what the consolidation took from it

The target files are cut from the exact histogram of the codes of each directory, so that they hold equally many
records, about ``rows_per_file``, however the codes cluster; records of one code are spread over its places by a hash
of their key, so that a code which holds a third of all records is many files.  The histogram is summed up in two
steps, by the upper and by the lower half of the code, so that no task adds up more than 2 ** BITS counts.  The shuffle
is by number of the file: a range shuffle whose ranges are the exact cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.functions.healpix import dir_of
from starmill.functions.hilbert import hilbert
from starmill.session import written

#: Bits of each of the two axes of the Hilbert curve, and of each half of a code.
BITS = 16
#: Most tasks of the shuffle to the files: a shuffle of as many tasks as there are files would not end at a million files.
MOST_TASKS = 10_000


def misfiled(df_dir: Column, pix: Column) -> Column:
    return F.coalesce(df_dir != dir_of(pix), F.lit(False))


def audit_files(records: DataFrame, files: DataFrame, moved: DataFrame, small_below: int) -> DataFrame:
    """(file_no, kind) of each file that is out of order; a file may be misfiled besides.

    moved: the records as ``consolidate`` wrote them.  empty: without rows. repeat: none of its records was taken from
    it, as each lies in a file of smaller number too. small: neither, and its num_rows (null and negative as 0) add up
    to less than ``small_below``. misfiled: a record whose directory is not that of its pixel, on either side; nulls are
    not compared, nor is the object side of Norder -1. A record without count_id is one of its own, so its file is no
    repeat.
    """
    owners = moved.select("file_no").distinct().withColumn("owns", F.lit(True))
    wrong = (F.coalesce(F.col("Norder") != -1, F.lit(True)) & misfiled(F.col("Dir"), F.col("Npix"))) | misfiled(F.col("join_Dir"), F.col("join_Npix"))
    held = records.where("file_no is not null").groupBy("file_no").agg(F.sum(F.greatest(F.coalesce("num_rows", F.lit(0)), F.lit(0))).alias("total"), F.max(wrong).alias("wrong"))
    state = files.select("file_no").where("file_no is not null").distinct().join(held, "file_no", "full").join(owners, "file_no", "left")
    main = F.when(F.col("total").isNull(), "empty").when(F.col("owns").isNull(), "repeat").when(F.col("total") < small_below, "small")
    kinds = F.filter(F.array(main, F.when(F.col("wrong"), "misfiled")), lambda k: k.isNotNull())
    return state.select("file_no", F.explode(kinds).alias("kind"))


def unique_records(records: DataFrame) -> DataFrame:
    """Each record once: of its copies the one in the file of smallest number, under its true directories.

    Records without count_id all stay. Null pixels keep the directory as written; Norder -1 has directory -1.
    """
    rest = [c for c in records.columns if c not in ("file_no", "count_id")]
    one = records.where("count_id is not null").groupBy("count_id").agg(F.min(F.struct("file_no", *rest)).alias("r")).select("count_id", "r.*")
    every = one.unionByName(records.where("count_id is null").select(*one.columns))
    true_dir = F.when(F.col("Norder") == -1, F.lit(-1).cast("bigint")).otherwise(F.coalesce(dir_of(F.col("Npix")), F.col("Dir")))
    return every.withColumns({"Dir": true_dir, "join_Dir": F.coalesce(dir_of(F.col("join_Npix")), F.col("join_Dir"))})


def plan_layout(records: DataFrame, rows_per_file: int) -> DataFrame:
    """Unique records with ``code`` and ``target_file`` (0, 1, ... within each Dir); columns of these names are replaced.

    The code is a Hilbert code over two axes: the places of the object and of the join cell along the sky's nested
    order, BITS bits each.  A directory of n records has ceil(n / rows_per_file) files of about equal size.
    """
    place = lambda pix, order: F.floor(F.when(F.col(order) >= 0, F.col(pix) / (F.pow(F.lit(4.0), F.col(order).cast("double")) * 12.0) * (1 << BITS)))
    unique = unique_records(records).withColumn("code", hilbert(BITS, place("Npix", "Norder"), place("join_Npix", "join_Norder")))
    unique = written(unique, "unique")  # for the histogram and the shuffle
    high = F.shiftright("code", BITS)
    histogram = written(unique.groupBy("Dir", high.alias("high"), "code").agg(F.count(F.lit(1)).alias("n")), "histogram")
    coarse = histogram.groupBy("Dir", "high").agg(F.sum("n").alias("m"))
    by_dir = W.partitionBy("Dir")
    coarse = coarse.select(F.col("Dir").alias("d"), F.col("high").alias("h"), (F.sum("m").over(by_dir.orderBy("high")) - F.col("m")).alias("before"), F.sum("m").over(by_dir).alias("total"))
    fine = histogram.withColumn("within", F.sum("n").over(W.partitionBy("Dir", "high").orderBy("code")) - F.col("n"))
    cuts = fine.join(coarse, F.col("Dir").eqNullSafe(F.col("d")) & (F.col("high") == F.col("h")))
    cuts = cuts.select(F.col("Dir").alias("__dir"), F.col("code").alias("__code"), (F.col("before") + F.col("within")).alias("__before"), F.col("n").alias("__n"), F.col("total").alias("__total"))
    joined = unique.join(cuts, unique["Dir"].eqNullSafe(cuts["__dir"]) & (unique["code"] == cuts["__code"]))
    at = F.col("__before") + F.pmod(F.xxhash64("count_id", "file_no", "join_Npix", "num_rows", "counted_at"), F.col("__n"))
    n_files = F.ceil(F.col("__total") / rows_per_file)
    return joined.withColumn("target_file", F.floor(at * n_files / F.col("__total")).cast("bigint")).drop("__dir", "__code", "__before", "__n", "__total")


def write_layout(plan: DataFrame, path: str) -> DataFrame:
    """Write one parquet file a (Dir, target_file), sorted by code; the written table, read again."""
    schema, spark = plan.schema, plan.sparkSession
    plan = written(plan, "plan")
    # the files of all directories, numbered in order: one row a directory
    sizes = plan.groupBy("Dir").agg((F.max("target_file") + 1).alias("n_files"))
    first = F.coalesce(F.sum("n_files").over(W.orderBy(F.asc_nulls_first("Dir")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = written(sizes.select(F.col("Dir").alias("__dir"), first.alias("__first"), "n_files"), "files")
    total = numbered.agg(F.coalesce(F.sum("n_files"), F.lit(0))).first()[0]
    if total:
        placed = plan.join(numbered.drop("n_files"), plan["Dir"].eqNullSafe(numbered["__dir"])).drop("__dir")
        tasks = min(int(total), MOST_TASKS)  # a task writes neighbouring files one after the other
        placed = placed.withColumns({"out_dir": F.col("Dir"), "out_file": F.col("target_file")}).repartitionById(tasks, F.floor((F.col("__first") + F.col("target_file")) * tasks / int(total)).cast("int"))
        placed.drop("__first").sortWithinPartitions("out_dir", "out_file", "code", "count_id").write.partitionBy("out_dir", "out_file").parquet(path)
    else:
        plan.write.parquet(path)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def digests(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Rows and an order-free digest (sums of two row hashes) of ``df`` by ``by``."""
    cols = [F.col(c) for c in sorted(columns)]
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("digest_a"), F.sum(F.crc32(text.cast("binary")).cast("decimal(38,0)")).alias("digest_b"))


def consolidate(records: DataFrame, path: str, rows_per_file: int) -> tuple[DataFrame, DataFrame]:
    """Write the layout; the written table, and (Dir, n_rows, same) a directory.

    ``same`` is true if rows and digests of the directory agree between the unique source records and the files
    read back.
    """
    columns = [c for c in records.columns if c != "file_no"]
    moved = write_layout(plan_layout(records, rows_per_file), path)
    source = digests(unique_records(records), columns, "Dir")
    target = digests(moved, columns, "Dir").select(F.col("Dir").alias("d"), F.col("n_rows").alias("t_rows"), F.col("digest_a").alias("t_a"), F.col("digest_b").alias("t_b"))
    both = source.join(target, source["Dir"].eqNullSafe(target["d"]), "full").withColumn("Dir", F.coalesce("Dir", "d"))
    same = F.coalesce((F.col("n_rows") == F.col("t_rows")) & (F.col("digest_a") == F.col("t_a")) & (F.col("digest_b") == F.col("t_b")), F.lit(False))
    return moved, both.select("Dir", "n_rows", same.alias("same"))


def compact(records: DataFrame, path: str, rows_per_file: int) -> DataFrame:
    """Consolidate and report: (Dir, n_files, n_rows, largest, in_order, same) a directory.

    largest: records of its largest file.  in_order: the codes of its files do not overlap.
    """
    moved, both = consolidate(records, path, rows_per_file)
    files = moved.groupBy("Dir", "target_file").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    files = files.withColumn("upto", F.lag("hi").over(W.partitionBy("Dir").orderBy("target_file")))
    sizes = files.groupBy("Dir").agg(F.count(F.lit(1)).alias("n_files"), F.max("n").alias("largest"), F.min(F.coalesce(F.col("upto") <= F.col("lo"), F.lit(True))).alias("in_order")).withColumnRenamed("Dir", "s")
    return both.join(sizes, both["Dir"].eqNullSafe(sizes["s"]), "left").select("Dir", "n_files", "n_rows", "largest", "in_order", "same")
