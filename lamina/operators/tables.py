"""Table operators: counting and ranking, sets of identifiers, intervals, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_uniq_count(df: DataFrame, column: str) -> DataFrame:
    """(count, value): values counted without regard to case, blank ones dropped; the first
    in sort order stands for its group."""
    held = df.where(F.trim(F.col(column)) != "")
    return held.groupBy(F.lower(column).alias("k")).agg(F.count("*").alias("count"), F.min(column).alias("value")).select("count", "value")


def sort_uniq_count_rank(df: DataFrame, column: str) -> DataFrame:
    """Adds the rank by count, then value: places in a global order, not one sorted task."""
    counted = sort_uniq_count(df, column).withColumn("_o", F.struct((-F.col("count")).alias("n"), F.col("value")))
    return with_place(counted, "_o", "rank").select("count", "value", (F.col("rank") + 1).cast("int").alias("rank"))


def numeric_first(x: Column) -> list[Column]:
    """Order of keys: whole numbers by size, numbers with a point by their whole part and
    the text of the rest, others by bytes."""
    digits = F.regexp_replace(x, "^0+(?=.)", "")
    whole, point = x.rlike("^[0-9]+$"), x.rlike(r"^[0-9]+\.[0-9]+$")
    kind = F.when(whole, 0).when(point, 1).otherwise(2)
    size = F.when(whole, F.length(digits)).when(point, F.length(F.regexp_extract(digits, r"^([0-9]*)\.", 1))).otherwise(0)
    return [kind, size, F.when(whole | point, digits).otherwise(x), x]


def union_ids(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for x in lists[1:]:
        out = out.union(x)
    return out.distinct()


def intersect_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keeps duplicates pairwise."""
    return a.intersectAll(b)


def exclude_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def difference_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """What either list has more of."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def fuse_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, length): intervals with swapped ends put right, then merged where
    they overlap, nest or touch."""
    low, high = F.least(start, end), F.greatest(start, end)
    rows = df.select(*keys, low.alias("start"), high.alias("end")).distinct()
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("start") > F.col("before") + 1).cast("int"), F.lit(1))).over(w)
    marked = rows.withColumn("before", before).withColumn("island", island)
    out = marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(*keys, "start", "end", (F.col("end") + 1 - F.col("start")).alias("length"))


def overlapping(a: DataFrame, low: int, high: int, start: str, end: str) -> DataFrame:
    return a.where((F.col(start) < high) & (F.col(end) > low))


def overlap_join(a: DataFrame, b: DataFrame, key: str, bin_width: int) -> DataFrame:
    """Pairs of rows of a (key, start, end) and b (key, low, high) whose intervals meet:
    start < high and end > low. Intervals meet in bins, and a pair counts in the first it shares."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor(F.col(e) / bin_width)))
    x, y = a.withColumn("bin", bins("start", "end")), b.withColumn("bin", bins("low", "high"))
    first = F.floor(F.greatest("start", "low") / bin_width)
    return x.join(y, [key, "bin"]).where((F.col("start") < F.col("high")) & (F.col("end") > F.col("low")) & (F.col("bin") == first)).drop("bin")


def varying_columns(df: DataFrame) -> list[str]:
    """Columns that hold more than one value."""
    row = df.agg(*((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if (row[c] or 0) > 1]


def uniq_table(df: DataFrame) -> DataFrame:
    """Without the columns that are constant."""
    return df.select(*varying_columns(df))


def groups_of(df: DataFrame, n: int, column: str, order: str, sep: str = ",") -> DataFrame:
    """(grp, joined): n values a line. The place of a row comes from range sorting and
    counts of the ranges, not from one sorted partition."""
    placed = with_place(df.select(F.col(order).alias("o"), F.col(column).cast("string").alias("v")), "o")
    item = F.struct("place", "v")
    return placed.groupBy(F.floor(F.col("place") / n).alias("grp")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]), sep).alias("joined"))


def with_place(df: DataFrame, order: str, name: str = "place") -> DataFrame:
    """Adds the 0-based place of each row in a global order. A first reader cuts the keys into
    ranges and keeps each one's least key and count; the rows look their range up in these, and
    each adds the counts before it. Ranges are sampled anew by each exchange, so the rows never
    rely on an exchange of their own. The number of ranges is given, so that none are merged."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col(order).alias("o"))  # never null itself, and a null in it comes first
    parts = df.select(key.alias("_low")).repartitionByRange(ranges, "_low").withColumn("_part", F.spark_partition_id())
    counts = parts.groupBy("_part").agg(F.min("_low").alias("_low"), F.count("*").alias("_n"))
    before = counts.select("_low", (F.sum("_n").over(Window.orderBy("_low")) - F.col("_n")).alias("_before"))
    bounds = before.agg(F.array_sort(F.collect_list(F.struct("_low", "_before"))).alias("_bounds"))
    # the last range that begins at or before the key, by halving steps; past the end is null
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(ranges.bit_length()))))
    at = F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get("_bounds", i + step - 1)["_low"] <= key, i + step).otherwise(i))
    rows = df.crossJoin(F.broadcast(bounds)).withColumn("_part", at)  # bounds are one row
    placed = rows.withColumn("_before", F.get("_bounds", F.col("_part") - 1)["_before"]).drop("_bounds")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("_w", within).withColumn(name, F.col("_before") + F.col("_w")).drop("_part", "_w", "_before")


def keep_from_nth(df: DataFrame, counts: DataFrame, uid: str, order: str) -> DataFrame:
    """Of each uid, rows from its nth on, n its number of rows in counts; unlisted go."""
    n = counts.groupBy(F.col(uid).alias("u")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(uid).orderBy(order)
    return df.withColumn("_i", F.row_number().over(w)).join(n, F.col(uid) == F.col("u")).where("_i >= n").drop("_i", "u", "n")


def align(df: DataFrame, right: list[str] = ()) -> DataFrame:
    """One text column: all columns padded to their widest value."""
    widths = df.agg(*(F.max(F.length(F.col(c).cast("string"))).alias(f"_w_{c}") for c in df.columns))
    both = df.crossJoin(F.broadcast(widths))  # widths are one row
    pad = lambda c: (F.lpad if c in right else F.rpad)(F.coalesce(F.col(c).cast("string"), F.lit("")), F.greatest(F.col(f"_w_{c}"), F.lit(1)), F.lit(" "))
    return both.select(F.concat_ws("  ", *(pad(c) for c in df.columns)).alias("line"))


def between_markers(df: DataFrame, order: str, is_first: Column, is_last: Column, keys: list[str] = ()) -> DataFrame:
    """Rows from the first marker to the second, both included, within each group of keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    begun = F.max(is_first.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    done = F.coalesce(F.max((is_last & (F.col("_b") == 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_b", begun).withColumn("_d", done).where("_b = 1 and _d = 0").drop("_b", "_d")


def filter_columns(df: DataFrame, condition: str) -> DataFrame:
    """Rows that a condition on columns holds for."""
    return df.where(F.expr(condition))


def reorder_columns(df: DataFrame, *places: int) -> DataFrame:
    """Columns by their place from 1, repeats allowed; a repeat gets a number."""
    seen: dict[str, int] = {}
    out = []
    for p in places:
        name = df.columns[p - 1]
        seen[name] = seen.get(name, 0) + 1
        out.append(F.col(name).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return df.select(*out)


def print_columns(df: DataFrame, *expressions: str, sep: str = "\t") -> DataFrame:
    """(line): expressions on columns, nulls as nothing, with separators between."""
    return df.select(F.concat_ws(sep, *(F.coalesce(F.expr(e).cast("string"), F.lit("")) for e in expressions)).alias("line"))


def words_at_a_time(df: DataFrame, key: str, column: str, accessions: bool = False) -> DataFrame:
    """(key, word): lower-case ASCII words in rows; accessions keep _ and . inside."""
    parts = F.split(F.lower(column), "[^a-z0-9_.]+" if accessions else "[^a-z0-9]+")
    return df.select(key, F.explode(parts).alias("word")).where("word <> ''")


def lookup(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """df with a column's values translated by table (key, value); others pass through."""
    t = table.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    joined = df.join(t, F.col(column) == F.col("_k"), "left")
    return joined.select(*(F.coalesce("_v", column).alias(c) if c == column else F.col(c) for c in df.columns))


def sample_ids(df: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """n values at random, the same for a seed: those with the least hashes."""
    return df.select(column).orderBy(F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{seed}"))), column).limit(n)


def gene_ranges(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, low, high, strand): the extent of all intervals of a gene; the strand is minus if
    they run backward, mixed if both ways."""
    back = (F.col(start) > F.col(end)).cast("int")
    g = df.groupBy(*keys).agg(F.min(F.least(start, end)).alias("low"), F.max(F.greatest(start, end)).alias("high"), F.min(back).alias("_a"), F.max(back).alias("_b"))
    strand = F.when(F.col("_a") != F.col("_b"), "mixed").when(F.col("_b") == 1, "minus").otherwise("plus")
    return g.select(*keys, "low", "high", strand.alias("strand"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df parted by keys into the session's number of partitions. Because that is given none are
    merged, so what a task sorts or aggregates is that share of the rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def split_at_gaps(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 30) -> DataFrame:
    """(keys, part, low, high): the runs of intervals, parted where at least `gap` places lie
    between the end so far and the next start. Repeated intervals count once: they stand next to
    each other and begin nothing, so they needn't be made distinct."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    item = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    again = F.coalesce(F.lag(item).over(w) == item, F.lit(False))  # nulls in structs are equal
    new = F.when(F.col("_again"), 0).otherwise(F.coalesce((F.col(start) - F.col("_before") - 1 >= gap).cast("int"), F.lit(1)))
    told = spread(df, *keys).withColumn("_before", before).withColumn("_again", again)
    marked = told.withColumn("part", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(*keys, "part").agg(F.min(start).alias("low"), F.max(end).alias("high"))


def aligned_value(x: Column, mode: str, width: Column, decimals: Column) -> Column:
    """A cell: l left, r right, c centred, n numbers right and others left, N and z as n with
    commas or zeros, m and M at the decimal point, M with commas."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    number = text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")
    whole, rest = F.regexp_extract(text, r"^([+-]?[0-9]+)", 1), F.regexp_extract(text, r"(\.[0-9]+)$", 1)
    commas = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",")
    right, left = lambda c: F.lpad(c, width, " "), lambda c: F.rpad(c, width, " ")
    if mode == "l":
        return left(text)
    if mode == "r":
        return right(text)
    if mode == "c":
        return left(F.concat(F.repeat(F.lit(" "), ((width - F.length(text)) / 2).cast("int")), text))
    shown = {"n": text, "N": F.concat(commas, rest), "z": F.lpad(text, width, "0"), "Z": F.lpad(text, width, "0"), "m": F.concat(whole, F.rpad(rest, decimals, " ")), "M": F.concat(commas, F.rpad(rest, decimals, " "))}[mode]
    return F.when(number, right(shown)).otherwise(left(text))


def align_columns(df: DataFrame, modes: str, least: int = 0, gap: int = 2) -> DataFrame:
    """(line): all columns aligned, a letter of modes for each, the last for the rest. Widths
    are found in a first pass and are one row."""
    own = {c: modes[min(i, len(modes) - 1)] for i, c in enumerate(df.columns)}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    decimals = lambda c: F.length(F.regexp_extract(text(c), r"^[+-]?[0-9]+(\.[0-9]+)$", 1))
    whole = lambda c: F.length(F.regexp_extract(text(c), r"^([+-]?[0-9]+)(\.[0-9]+)?$", 1))
    sizes = []
    for c, m in own.items():
        d = F.max(decimals(c)) if m in "mM" else F.lit(0)
        commas = F.max(F.floor((F.greatest(whole(c), F.lit(1)) - 1) / 3)) if m in "NM" else F.lit(0)
        wide = F.greatest(F.max(F.length(text(c))), F.max(whole(c)) + d) if m in "mM" else F.max(F.length(text(c)))
        sizes += [F.greatest(wide + commas, F.lit(max(1, least))).cast("int").alias(f"_w_{c}"), d.cast("int").alias(f"_d_{c}")]
    both = df.crossJoin(F.broadcast(df.agg(*sizes)))  # sizes are one row
    cells = [aligned_value(F.col(c), m, F.col(f"_w_{c}"), F.col(f"_d_{c}")) for c, m in own.items()]
    return both.select(F.rtrim(F.concat_ws(" " * gap, *cells)).alias("line"))
