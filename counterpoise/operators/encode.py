"""Label encoding, scaling and decoding: fit once, transform anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.lineage import materialise, write_down
from counterpoise.operators.lookup import HOT_ROWS, fits_broadcast, lookup_join
from counterpoise.operators.ranking import running_sum

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value, as in a table read with pandas."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in df.dtypes if t in ("float", "double")})


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if is_numeric(t) and c not in skip]


def string_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in skip]


def melt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(attr, value) with every value as a string, from one scan."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    return df.select(F.explode(cells).alias("cell")).select("cell.attr", "cell.value")


def label_domain(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(attr, value, idx): values of each column in ascending order, numbered from 0.

    One shuffle for all columns. The numbering runs over distinct values only.
    """
    values = melt(df, cols).filter(F.col("value").isNotNull()).distinct().withColumn("_one", F.lit(1))
    ranked = running_sum(values, ["attr"], ["value"], {"_rank": "_one"})
    return ranked.select("attr", "value", (F.col("_rank") - 1).alias("idx"))


def _value_counts(cells: DataFrame) -> DataFrame:
    """(attr, value, _rows) of values that many rows hold, for all columns from one scan."""
    counts = cells.filter(F.col("value").isNotNull()).groupBy("attr", "value").agg(F.count(F.lit(1)).alias("_rows"))
    return materialise(counts.filter(F.col("_rows") > HOT_ROWS))


@dataclass
class LabelEncoder:
    """Codes of string (or forced) columns. ``sizes`` holds the number of classes."""

    cols: list[str]
    domain: DataFrame
    sizes: dict[str, int]
    small: bool

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> LabelEncoder:
        written = write_down(label_domain(df, cols))
        domain = written.df
        sizes = {r["attr"]: r["n"] for r in domain.groupBy("attr").agg(F.count(F.lit(1)).alias("n")).collect()}
        return cls(list(cols), domain, sizes, fits_broadcast(written))

    def _codes(self, col: str) -> DataFrame:
        return self.domain.filter(F.col("attr") == col)

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        """Replace values by codes; an unseen value gets code 0, the first class."""
        cols = list(cols if cols is not None else self.cols)
        names = df.columns
        counts = None if self.small else _value_counts(melt(df, cols))
        for col in cols:
            table = self._codes(col).select(F.col("value").alias("_v"), F.col("idx").alias("_i"))
            seen = None if counts is None else counts.filter(F.col("attr") == col).select(F.col("value").alias("_v"), "_rows")
            df = lookup_join(
                df.withColumn("_v", F.col(col).cast("string")), table, ["_v"], "left", small=self.small or None, rows_per_key=seen
            ).withColumn(col, F.coalesce("_i", F.lit(0)).cast("bigint"))
            df = df.select(*names)
        return df

    def decode(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        """Codes (possibly fractional or out of range) back to labels."""
        cols = list(cols if cols is not None else self.cols)
        names = df.columns
        counts = None
        if not self.small:
            coded = df.select(*[nearest_code(F.col(c), self.sizes[c]).alias(c) for c in cols])
            counts = _value_counts(melt(coded, cols))
        for col in cols:
            table = self._codes(col).select(F.col("idx").alias("_i"), F.col("value").alias("_v"))
            seen = None if counts is None else counts.filter(F.col("attr") == col).select(F.col("value").cast("bigint").alias("_i"), "_rows")
            df = lookup_join(
                df.withColumn("_i", nearest_code(F.col(col), self.sizes[col])),
                table,
                ["_i"],
                "left",
                small=self.small or None,
                rows_per_key=seen,
            ).withColumn(col, F.col("_v"))
            df = df.select(*names)
        return df


def nearest_code(x: Column, classes: int) -> Column:
    """Round half to even, then clip into [0, classes - 1]; null stays null."""
    clipped = F.greatest(F.lit(0), F.least(F.lit(classes - 1), F.bround(x.cast("double"), 0))).cast("bigint")
    return F.when(x.isNotNull(), clipped)


@dataclass
class StandardScaler:
    """Mean and population deviation per column; a constant column is only centred."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> StandardScaler:
        if not cols:
            return cls({})
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        return cls({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols})

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {
            c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items() if c in df.columns
        }
        return df.withColumns(scaled) if scaled else df
