"""Feature preparation: roles, imputation, encoding, scaling; fitted once, applied anywhere.

Everything that is fitted comes from the table of value counts, so fitting is one
shuffle of the table; applying is a projection without any shuffle or Python.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..functions.columns import col, is_numeric, is_time, normalize, pin
from ..functions.quantiles import quantiles
from .cells import counted, number, text
from .profile import _top_values

# Names that mark identifiers here, and the texts of boolean columns.
IDENTIFIER_PATTERNS = (r"^id$", r"_id$", r"^id_", r"^customer_?id", r"^user_?id", r"^transaction_?id",
                       r"^uuid$", r"^guid$", r"^email$", r"_uuid$")
BOOLEAN_TEXTS = ("true", "false", "1", "0", "yes", "no")
TRUE_TEXTS = ("true", "1", "yes")
DATE_PARTS = (("year", 2000.0), ("month", 1.0), ("day", 1.0), ("dayofweek", 0.0))
UNIQUE_TEXT_SHARE = 0.99
MISSING_CATEGORY = "missing"


@dataclass(frozen=True)
class Role:
    column: str
    role: str                  # numeric, boolean, datetime, categorical or excluded
    reason: str | None = None
    day_first: bool = False


def _role(f: T.StructField, seen, rows: int, max_categories: int, semantic: str | None) -> Role:
    """First match wins."""
    name, dtype = f.name, f.dataType
    numeric = is_numeric(dtype) or isinstance(dtype, T.BooleanType)
    if seen is None:
        return Role(name, "excluded", "all_null")
    if semantic == "identifier":
        return Role(name, "excluded", "identifier (detected_by_semantic_profile)")
    for pattern in IDENTIFIER_PATTERNS:
        if re.search(pattern, name.lower().strip()):
            return Role(name, "excluded", f"identifier (name_matches_pattern_{pattern})")
    if not numeric and rows >= 5 and seen.unique / seen.present >= UNIQUE_TEXT_SHARE:
        return Role(name, "excluded", "identifier (high_uniqueness_text)")
    if rows > 1 and seen.unique <= 1:
        return Role(name, "excluded", "constant_feature")
    if is_time(dtype) or (not numeric and seen.all_dates):
        return Role(name, "datetime", None, bool(seen.day_first))
    if isinstance(dtype, T.BooleanType) or (not numeric and seen.all_flags):
        return Role(name, "boolean")
    if is_numeric(dtype):
        return Role(name, "numeric")
    if seen.unique > max_categories and rows >= 10:
        return Role(name, "excluded",
                    f"high_cardinality ({seen.unique} unique > threshold {max_categories})")
    return Role(name, "categorical")


def _roles(df: DataFrame, counts: DataFrame, rows: int, max_categories: int,
           profile: DataFrame | None) -> list[Role]:
    w = F.col("weight")
    s = F.when(F.col("long_text").isNull(), F.col("s"))
    first_month, first_day = dates.month_first(s), dates.day_first(s)
    seen = {r.ordinal: r for r in counts.groupBy("ordinal").agg(
        F.sum(w).alias("present"), F.count("*").alias("unique"),
        F.every(dates.parse_text(s).isNotNull()).alias("all_dates"),
        F.every(F.coalesce(F.lower(s).isin(*BOOLEAN_TEXTS), F.lit(False))).alias("all_flags"),
        (F.count_if(first_day.isNotNull()) > F.count_if(first_month.isNotNull())).alias("day_first"),
    ).collect()}
    semantic = {} if profile is None else {
        r.column: r.semantic_type for r in profile.select("column", "semantic_type").collect()}
    return [_role(f, seen.get(i), rows, max_categories, semantic.get(f.name))
            for i, f in enumerate(df.schema.fields)]


def feature_roles(df: DataFrame, profile: DataFrame | None = None, max_categories: int = 50) -> DataFrame:
    """(column, role, reason) in table order."""
    rows = df.count()
    with counted(df) as counts:
        roles = _roles(df, counts, rows, max_categories, profile)
    return df.sparkSession.createDataFrame([(r.column, r.role, r.reason) for r in roles],
                                           "column string, role string, reason string")


def feature_key(column: str, part: str = "") -> str:
    """What a feature is told apart by; names such as ``a_b`` may come from several columns."""
    return json.dumps([column, part])


@dataclass(frozen=True)
class FeatureModel:
    """Fitted preparation. Its size is bounded by columns x ``max_categories``."""
    columns: list[str]
    roles: list[Role]
    numeric_imputation: str
    scaling: str | None
    rows: int
    numeric_fill: dict[str, float] = field(default_factory=dict)
    category_fill: dict[str, str] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    centre_scale: dict[str, tuple[float, float]] = field(default_factory=dict)

    def of(self, role: str) -> list[Role]:
        return [r for r in self.roles if r.role == role]

    def _unscaled(self, present: set[str], schema: T.StructType) -> dict[tuple[str, str], Column]:
        """(column, part) -> expression, in order: numeric, boolean, date parts, one-hot.

        A column the given table lacks is filled as if all its values were missing.
        """
        def source(name: str) -> Column:
            return col(name) if name in present else F.lit(None).cast("string")

        out: dict[tuple[str, str], Column] = {}
        for r in self.of("numeric"):
            value = source(r.column).try_cast("double")
            out[r.column, ""] = F.coalesce(value, F.lit(self.numeric_fill[r.column]))
        for r in self.of("boolean"):
            flag = F.lower(source(r.column).cast("string")).isin(*TRUE_TEXTS)
            out[r.column, ""] = F.coalesce(flag, F.lit(False)).cast("double")
        for r in self.of("datetime"):
            c = source(r.column)
            typed = r.column in present and is_time(schema[r.column].dataType)
            for part, value in _date_parts(c if typed else dates.parse_text(c, r.day_first)).items():
                out[r.column, part] = value
        for r in self.of("categorical"):
            value = F.coalesce(source(r.column).cast("string"), F.lit(self.category_fill[r.column]))
            for category in self.categories[r.column]:
                out[r.column, category] = F.when(value == category, 1.0).otherwise(0.0)
        return out

    @property
    def feature_names(self) -> list[str]:
        """One name per feature: the column, or column and part; later ones of the same name get a number."""
        names: list[str] = []
        taken: set[str] = set()
        for column, part in self._unscaled(set(), T.StructType()):
            plain = name = f"{column}_{part}" if part or column in self.categories else column
            n = 1
            while name in taken:
                n += 1
                name = f"{plain}_{n}"
            taken.add(name)
            names.append(name)
        return names

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The ``keep`` columns and one double column per feature."""
        kept = [] if keep is None else keep
        normal = normalize(df)
        scaled = []
        features = self._unscaled(set(df.columns), normal.schema)
        for name, (feature, value) in zip(self.feature_names, features.items()):
            centre, scale = self.centre_scale.get(feature_key(*feature), (0.0, 1.0))
            scaled.append(((value - F.lit(centre)) / F.lit(scale)).alias(name))
        return normal.select(*[col(k) for k in kept], *scaled)

    def summary(self, spark) -> DataFrame:
        """(item, name, value): columns by role, reasons, fitted values, shape."""
        lines = [("shape", "rows", str(self.rows)), ("shape", "features", str(len(self.feature_names))),
                 ("strategy", "numeric_imputation", self.numeric_imputation),
                 ("strategy", "encoding", "one_hot"),
                 ("strategy", "scaling", str(self.scaling).lower())]
        lines += [(r.role, r.column, r.reason) for r in self.roles]
        lines += [("numeric_fill", k, repr(v)) for k, v in self.numeric_fill.items()]
        lines += [("category_fill", k, v) for k, v in self.category_fill.items()]
        lines += [("categories", k, str(len(v))) for k, v in self.categories.items()]
        lines += [("feature", n, str(i)) for i, n in enumerate(self.feature_names)]
        return spark.createDataFrame(lines, "item string, name string, value string")


def _date_parts(ts: Column) -> dict[str, Column]:
    values = (F.year(ts), F.month(ts), F.dayofmonth(ts), F.weekday(ts))
    return {part: F.coalesce(v.cast("double"), F.lit(default))
            for (part, default), v in zip(DATE_PARTS, values)}


def _fills(counts: DataFrame, model: FeatureModel, ordinals: dict[str, int]) -> dict[str, float]:
    names = {ordinals[r.column]: r.column for r in model.of("numeric")}
    if model.numeric_imputation == "zero" or not names:
        return {n: 0.0 for n in names.values()}
    values = (counts.where(F.col("ordinal").isin(list(names)))
              .select("ordinal", number().alias("value"), "weight").where("value IS NOT NULL"))
    if model.numeric_imputation == "mean":
        w = F.col("weight")
        fitted = values.groupBy("ordinal").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("fill"))
    else:
        fitted = quantiles(values, ["ordinal"], [0.5]).withColumnRenamed("quantile", "fill")
    return {names[r.ordinal]: r.fill for r in fitted.collect()}


def _categories(df: DataFrame, counts: DataFrame, model: FeatureModel, ordinals: dict[str, int],
                max_categories: int) -> dict[str, list]:
    """Category rows (most frequent first) of each categorical column, at most ``max_categories`` each."""
    names = {ordinals[r.column]: r.column for r in model.of("categorical")}
    if not names:
        return {}
    top = _top_values(df, counts.where(F.col("ordinal").isin(list(names))), max_categories)
    found: dict[str, list] = {n: [] for n in names.values()}
    for r in sorted(top.collect(), key=lambda r: r.rank):
        found[names[r.ordinal]].append(r)
    return found


def _feature_values(counts: DataFrame, model: FeatureModel, ordinals: dict[str, int],
                    category_rows: dict[str, list]) -> DataFrame:
    """(feature, value, weight) over the training rows, from the value counts."""
    spark = counts.sparkSession
    schema = "feature string, value double, weight long"
    present = {r.ordinal: r.n for r in counts.groupBy("ordinal").agg(F.sum("weight").alias("n")).collect()}
    fixed: list[tuple[str, float, int]] = []
    parts: list[DataFrame] = []

    def missing(column: str) -> int:
        return model.rows - present.get(ordinals[column], 0)

    def rows_of(column: str) -> DataFrame:
        return counts.where(F.col("ordinal") == ordinals[column])

    for r in model.of("numeric"):
        parts.append(rows_of(r.column).select(F.lit(feature_key(r.column)).alias("feature"),
                                              number().alias("value"), "weight"))
        fixed.append((feature_key(r.column), model.numeric_fill[r.column], missing(r.column)))
    for r in model.of("boolean"):
        flag = F.coalesce(F.lower(text()).isin(*TRUE_TEXTS), F.lit(False)).cast("double")
        parts.append(rows_of(r.column).select(F.lit(feature_key(r.column)).alias("feature"),
                                              flag.alias("value"), "weight"))
        fixed.append((feature_key(r.column), 0.0, missing(r.column)))
    for r in model.of("datetime"):
        ts = F.coalesce("t", dates.parse_text(F.col("s"), r.day_first).cast("timestamp_ntz"))
        pieces = F.inline(F.array(*[
            F.struct(F.lit(feature_key(r.column, part)).alias("feature"), value.alias("value"),
                     F.col("weight").alias("weight")) for part, value in _date_parts(ts).items()]))
        parts.append(rows_of(r.column).select(pieces))
        fixed += [(feature_key(r.column, part), default, missing(r.column)) for part, default in DATE_PARTS]
    for column, rows in category_rows.items():
        for row in rows:
            ones = row.frequency + (missing(column) if row.value == model.category_fill[column] else 0)
            fixed += [(feature_key(column, row.value), 1.0, ones),
                      (feature_key(column, row.value), 0.0, model.rows - ones)]
    out = spark.createDataFrame([x for x in fixed if x[2] > 0], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


def _fit_scaling(values: DataFrame, scaling: str) -> dict[str, tuple[float, float]]:
    x, w = F.col("value"), F.col("weight")
    if scaling == "robust":
        cut = quantiles(values, ["feature"], [0.25, 0.5, 0.75])
        fitted = cut.groupBy("feature").agg(
            F.max(F.when(F.col("p") == 0.5, F.col("quantile"))).alias("centre"),
            (F.max(F.when(F.col("p") == 0.75, F.col("quantile")))
             - F.max(F.when(F.col("p") == 0.25, F.col("quantile")))).alias("scale"))
    elif scaling == "minmax":
        fitted = values.groupBy("feature").agg(F.min(x).alias("centre"), (F.max(x) - F.min(x)).alias("scale"))
    elif scaling == "standard":
        means = pin(values.groupBy("feature").agg((F.sum(w * x) / F.sum(w)).alias("centre")))
        e = x - F.col("centre")
        fitted = (values.join(F.broadcast(means), "feature").groupBy("feature", "centre")
                  .agg(F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("scale")))   # population deviation
    else:
        raise ValueError(f"unknown scaling {scaling!r}: standard, minmax, robust or None")
    return {r.feature: (r.centre, r.scale if r.scale else 1.0) for r in fitted.collect()}


def fit_features(df: DataFrame, profile: DataFrame | None = None, numeric_imputation: str = "median",
                 scaling: str | None = "standard", max_categories: int = 50) -> FeatureModel:
    """Learn roles, fills, categories and scales from the training rows only."""
    if numeric_imputation not in ("median", "mean", "zero"):
        raise ValueError(f"unknown imputation {numeric_imputation!r}: median, mean or zero")
    rows = df.count()
    ordinals = {c: i for i, c in enumerate(df.columns)}
    with counted(df) as counts:
        model = FeatureModel(df.columns, _roles(df, counts, rows, max_categories, profile),
                             numeric_imputation, scaling, rows)
        model.numeric_fill.update(_fills(counts, model, ordinals))
        found = _categories(df, counts, model, ordinals, max_categories)
        model.category_fill.update({c: r[0].value if r else MISSING_CATEGORY for c, r in found.items()})
        model.categories.update({c: sorted(x.value for x in r) for c, r in found.items()})
        if scaling and (model.feature_names):
            model.centre_scale.update(_fit_scaling(_feature_values(counts, model, ordinals, found), scaling))
    return model


def assemble(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    """Add the vector column that ``pyspark.ml`` works on."""
    plain = {f: f"_f{i}" for i, f in enumerate(features)}      # names with dots confuse the assembler
    staged = df.withColumns({alias: col(f) for f, alias in plain.items()})
    return (VectorAssembler(inputCols=list(plain.values()), outputCol=output)
            .transform(staged).drop(*plain.values()))


def expand_array(df: DataFrame, column: str, size: int, prefix: str = "feature_") -> tuple[DataFrame, list[str]]:
    """One double column per element of an array column."""
    names = [f"{prefix}{i}" for i in range(size)]
    out = df.select(*[col(c) for c in df.columns if c != column],
                    *[col(column)[i].cast("double").alias(n) for i, n in enumerate(names)])
    return out, names


def tall(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, value): one row per feature of each row; no shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), col(f).cast("double").alias("value"))
                      for f in features])
    return df.select(*[col(k) for k in keep], F.inline(pairs))
