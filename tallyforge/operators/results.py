"""What can be done with cells: merge, scale, integrate, rebin, fold, export, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fill import CELL


def merge(*cells: DataFrame, keys: Sequence[str] = (), axes: Sequence[dict[str, tuple]] = ()) -> DataFrame:
    """Adds up equal cells of all inputs, in one aggregation; the order doesn't matter. ``axes``: the
    books' kinds (``Store.book.kinds``) of the inputs, which must agree."""
    for other in axes[1:]:
        check_axes(axes[0], other)
    whole = cells[0]
    for c in cells[1:]:
        whole = whole.unionByName(c)
    return whole.groupBy(*keys, *CELL).agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"), F.sum("entries").alias("entries"))


def check_axes(declared: dict[str, tuple], other: dict[str, tuple]) -> None:
    """Raises if a path has another kind or other axes in two books."""
    for path in declared.keys() & other.keys():
        if declared[path] != other[path]:
            raise TypeError(f"{path} has other axes: {declared[path]} and {other[path]}")


def scale(cells: DataFrame, by: Column | float) -> DataFrame:
    """Weights times ``by``; entries of histograms times ``by``, cut to whole numbers."""
    by = by if isinstance(by, Column) else F.lit(float(by))
    return cells.withColumns({"sumw": F.col("sumw") * by, "sumw2": F.col("sumw2") * by * by, "entries": (F.col("entries") * by).cast("long")})


def integral(cells: DataFrame, bins: dict[str, Sequence[int]]) -> DataFrame:
    """Sum of weights without under- and overflow; ``bins``: for each path the bins by axis."""
    inside = F.lit(False)
    for path, sizes in bins.items():
        own = F.col("path") == path
        for n, name in zip(sizes, ("bx", "by", "bz"), strict=False):
            own = own & F.col(name).between(1, n)
        inside = inside | own
    return cells.groupBy("path").agg(F.coalesce(F.sum(F.when(inside, F.col("sumw"))), F.lit(0.0)).alias("integral"), F.sum("entries").alias("entries"))


def rebin(cells: DataFrame, by: int, bins: int) -> DataFrame:
    """Joins ``by`` neighbouring bins of 1-d histograms; ``bins`` before, a multiple of ``by``."""
    if bins % by:
        raise ValueError("bins must be a multiple")
    bx = F.when(F.col("bx") == 0, 0).when(F.col("bx") > bins, bins // by + 1).otherwise(F.floor((F.col("bx") - 1) / by) + 1)
    return merge(cells.withColumn("bx", bx.cast("int")))


def fold_overflow(cells: DataFrame, bins: int) -> DataFrame:
    """Adds under- and overflow of 1-d histograms to the first and last bin."""
    return merge(cells.withColumn("bx", F.greatest(F.lit(1), F.least(F.lit(bins), F.col("bx"))).cast("int")))


def index(bx: Column, by: Column, bz: Column, nx: int, ny: int) -> Column:
    """A cell's place in the dense array."""
    return bx + (nx + 2) * (F.coalesce(by, F.lit(0)) + (ny + 2) * F.coalesce(bz, F.lit(0)))


def dense(cells: DataFrame, nx: int, ny: int = -1, nz: int = -1) -> DataFrame:
    """path, data and weights_squared as dense arrays, and entries. A histogram has a fixed
    number of cells, so an array is as large as its axes."""
    size = (nx + 2) * (ny + 2 if ny >= 0 else 1) * (nz + 2 if nz >= 0 else 1)
    at = index(F.col("bx"), F.col("by"), F.col("bz"), nx, max(ny, -1))
    pairs = cells.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("i"), F.struct("sumw", "sumw2").alias("v")))).alias("m"), F.sum("entries").alias("entries"))
    slots = F.sequence(F.lit(0), F.lit(size - 1))
    take = lambda what: F.transform(slots, lambda i: F.coalesce(F.element_at("m", i)[what], F.lit(0.0)))
    return pairs.select("path", take("sumw").alias("data"), take("sumw2").alias("weights_squared"), "entries")


def paths(cells: DataFrame, kind: str | None = None) -> DataFrame:
    return (cells if kind is None else cells.where(F.col("kind") == kind)).select("path", "kind").distinct().orderBy("path")


def cut_flow(cells: DataFrame) -> DataFrame:
    """Counters of cut-flows: of one name the counts add up at its first place."""
    return cells.where("kind = 'CUTFLOW'").groupBy("path", "cut").agg(F.min("ordinal").alias("ordinal"), F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"), F.sum("entries").alias("entries"))


def ordered_cut_flow(cells: DataFrame, path: str, cuts: Sequence[str]) -> DataFrame:
    """The declared counters in their order, 0 where nothing passed."""
    spark = cells.sparkSession
    declared = spark.createDataFrame([(c, i) for i, c in enumerate(cuts)], "cut string, ordinal int")
    got = cut_flow(cells.where(F.col("path") == path)).drop("ordinal", "path")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return declared.join(got, "cut", "left").select(F.lit(path).alias("path"), "cut", "ordinal", zero("sumw"), zero("sumw2"), zero("entries"))


def efficiency(flow: DataFrame) -> DataFrame:
    """100 times each counter over the one before it; one flow has few counters."""
    before = F.lag("sumw").over(Window.partitionBy("path").orderBy("ordinal"))
    return flow.withColumn("efficiency", F.try_divide(100.0 * F.col("sumw"), before))


def clamped_sum(cells: DataFrame, path: Column) -> DataFrame:
    """Sum of histograms into ``path``, negative cells counting as 0."""
    return cells.withColumn("sumw", F.greatest("sumw", F.lit(0.0))).groupBy(path.alias("path"), "bx").agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"))


def ratio(data: DataFrame, model: DataFrame) -> DataFrame:
    """Data over model by bin (bx, sumw, sumw2); 0 where the model is not above 0."""
    both = _sides(data, model)
    return both.withColumn("ratio", F.when(F.col("m") > 0, F.try_divide("d", "m")).otherwise(0.0))


def pull(data: DataFrame, model: DataFrame) -> DataFrame:
    """(d - m) / sqrt(var m + max(sigma d, 1)^2); 0 where there are no data."""
    both = _sides(data, model)
    pulled = (F.col("d") - F.col("m")) / F.sqrt(F.col("m2") + F.greatest(F.col("d2"), F.lit(1.0)))
    return both.withColumn("pull", F.when(F.col("d") > 0, pulled).otherwise(0.0))


def _sides(data: DataFrame, model: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    left = data.select("bx", F.col("sumw").alias("d"), F.col("sumw2").alias("d2"))
    right = model.select("bx", F.col("sumw").alias("m"), F.col("sumw2").alias("m2"))
    return left.join(right, "bx", "full").select("bx", zero("d"), zero("d2"), zero("m"), zero("m2"))


def significance(signal: Column, background: Column, stat: Column, syst: Column) -> Column:
    return F.try_divide(signal, F.sqrt(background + stat * stat + syst * syst))


def combine(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds up numbers (value, stat): stat errors add in squares, NaN ones don't count."""
    stat = F.when(~F.isnan("stat"), F.col("stat") * F.col("stat"))
    return parts.groupBy(*keys).agg(F.sum("value").alias("value"), F.sqrt(F.coalesce(F.sum(stat), F.lit(0.0))).alias("stat"))


def systematic_error(shifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, source, shift): root of the sum over sources of the squared mean |shift|."""
    each = shifts.groupBy(*keys, "source").agg(F.avg(F.abs("shift")).alias("mean"))
    return each.groupBy(*keys).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("syst"))


def round_to_error(value: float, error: float, digits: int = 2, most: int = 2) -> tuple[float, float]:
    """Both rounded so that the error shows ``digits`` digits, to ``most`` decimals; the value keeps
    a digit of its own where that rounds it to 0."""
    import math

    if math.isnan(error) or math.isnan(value):
        return value, error
    decade = lambda x: math.floor(math.log10(abs(x))) if x else 0
    places = min(digits - 1 - decade(error), most)
    return round(value, max(places, -decade(value))), round(error, places)


def listing(cells: DataFrame, bins: dict[str, int] | None = None) -> DataFrame:
    """Cells in order, as one reads them; of 2- and 3-d histograms without under- and overflow,
    ``bins`` giving the inner bins of their first axis."""
    flat = F.col("by").isNull()
    inner = (F.col("bx") > 0) & (F.col("by") > 0) & (F.col("bz").isNull() | (F.col("bz") > 0))
    for path, n in (bins or {}).items():
        inner = inner & ((F.col("path") != path) | (F.col("bx") <= n))
    shown = cells.where(flat | inner)
    return shown.withColumn("error", F.sqrt("sumw2")).orderBy("path", "ordinal", "bz", "by", "bx")


def cut_table(flows: DataFrame, samples: Sequence[str], background: Sequence[str]) -> DataFrame:
    """A row for each counter and a column for each sample (of ``flows`` with ``sample``), and the
    sum of the background ones with its error."""
    value = flows.groupBy("cut").agg(
        F.min("ordinal").alias("ordinal"),
        *[F.coalesce(F.sum(F.when(F.col("sample") == s, F.col("sumw"))), F.lit(0.0)).alias(s) for s in samples],
        F.coalesce(F.sum(F.when(F.col("sample").isin(*background), F.col("sumw"))), F.lit(0.0)).alias("background"),
        F.sqrt(F.coalesce(F.sum(F.when(F.col("sample").isin(*background), F.col("sumw2"))), F.lit(0.0))).alias("error"),
    )
    return value.orderBy("ordinal")


def stacked(cells: DataFrame, bins: int, first: str = "QCD") -> DataFrame:
    """Paths in the order in which they are stacked: ``first``, then by their integrals over the
    ``bins`` inner bins."""
    inner = F.when(F.col("bx").between(1, bins), F.col("sumw")).otherwise(0.0)
    return cells.groupBy("path").agg(F.sum(inner).alias("integral")).withColumn("place", F.row_number().over(Window.orderBy(F.col("path") != first, "integral", "path")))


def as_latex(rows: list, columns: Sequence[str], digits: int = 2) -> str:
    """A table of collected rows."""
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    lines = [" & ".join(c.replace("_", r"\_") for c in columns), *(" & ".join(cell(r[c]) for c in columns) for r in rows)]
    return "\\begin{tabular}{l" + "r" * (len(columns) - 1) + "}\n" + " \\\\\n".join(lines) + " \\\\\n\\end{tabular}"
