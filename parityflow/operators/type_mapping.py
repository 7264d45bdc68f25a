"""Type mapping between engines as joins over a table of column types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.functions import typerules as R
from parityflow.functions.casts import held
from parityflow.functions.equality import cell_text
from parityflow.functions.keys import q

CANONICAL = "struct<kind:string,p:bigint,s:bigint,depth:int,raw:string>"


def _squeeze(c: Column) -> Column:
    return F.trim(F.lower(c))


def parse_native_type(c: Column) -> Column:
    """``DECIMAL(18,2)`` to ``struct(base, p1, p2)``; ``max`` counts as the largest number."""
    halves = F.split(_squeeze(c), r"\(", 2)
    inside = F.trim(F.rtrim(F.get(halves, F.lit(1)), F.lit(")")))
    parts = F.split(inside, ",")

    def number(i: int) -> Column:
        value = F.get(parts, F.lit(i)).try_cast("bigint")
        return F.when(value.between(0, R.MAX), value)

    p1 = F.when(inside == "max", F.lit(R.MAX)).otherwise(number(0))
    return F.struct(F.trim(halves[0]).alias("base"), p1.alias("p1"), number(1).alias("p2"))


def _byte(c: Column) -> Column:
    """Precision and scale are kept in one byte."""
    return F.pmod(c, F.lit(256))


def canonicalise(df: DataFrame, engine: str, data_type: str, out: str = "canonical") -> DataFrame:
    """Add the canonical type of column ``data_type`` of the engine named in column ``engine``."""
    rules = F.broadcast(  # a fixed list of names
        df.sparkSession.createDataFrame(
            R.native_rules(),
            "__engine string, __base string, __kind string, __fp bigint, __fs bigint, __dp bigint, __ds bigint",
        )
    )
    text = _squeeze(q(data_type))
    postgres = q(engine) == "PostgreSql"
    # arrays: strip trailing [] pairs; a known name with parameters wins over its [] though
    suffix = F.when(postgres, F.regexp_extract(text, r"((?:\[\]\s*)*)$", 1)).otherwise(F.lit(""))
    levels = F.floor(F.length(F.regexp_replace(suffix, r"\s", "")) / 2).cast("int")
    inner = F.trim(F.left(text, F.length(text) - F.length(suffix)))
    parsable = F.when(F.instr(text, "(") > 0, text).otherwise(inner)
    names = df.columns
    parsed = df.select("*", inner.alias("__text"), levels.alias("__levels"), parse_native_type(parsable).alias("__t"))
    joined = parsed.join(
        rules, (q(engine) == F.col("__engine")) & (F.col("__t.base") == F.col("__base")), "left_outer"
    )
    plain = (F.instr(_squeeze(q(data_type)), "(") == 0) | F.col("__kind").isNull()
    joined = joined.withColumn("__depth", F.when(plain, F.col("__levels")).otherwise(0))
    base, p1, p2, kind0 = F.col("__t.base"), F.col("__t.p1"), F.col("__t.p2"), F.col("__kind")
    is_engine = lambda name: q(engine) == name

    number = (
        F.when((p1 == 1) & F.coalesce(p2 == 0, F.lit(True)), F.lit("Boolean"))
        .when(p2 > 0, F.lit("Decimal"))
        .when(p1 <= 5, F.lit("SmallInt"))
        .when(p1 <= 10, F.lit("Int"))
        .when(p1 <= 19, F.lit("BigInt"))
        .otherwise(F.lit("Decimal"))
    )
    affinity = F.lit(None).cast("string")
    for name, kind in R.SQLITE_EXACT.items():
        affinity = F.coalesce(affinity, F.when(F.col("__text") == name, F.lit(kind)))
    for piece, kind in R.SQLITE_CONTAINS:
        affinity = F.coalesce(affinity, F.when(F.contains(F.col("__text"), F.lit(piece)), F.lit(kind)))
    affinity = F.coalesce(affinity, F.lit(R.SQLITE_OTHER))
    oracle_number = is_engine("Oracle") & (base == "number")
    is_max = is_engine("SqlServer") & (p1 == R.MAX)
    kind = (
        F.when(is_engine("Sqlite"), affinity)
        .when(oracle_number, number)
        .when(is_engine("MySql") & (base == "tinyint") & (p1 == 1), F.lit("Boolean"))
        .when(is_engine("Oracle") & (base == "raw") & (p1 == 16), F.lit("Uuid"))
        .when(is_max & (base == "varchar"), F.lit("Text"))
        .when(is_max & (base == "nvarchar"), F.lit("NText"))
        .when(is_max & (base == "varbinary"), F.lit("Blob"))
        .when(kind0.startswith("Unknown"), F.lit("Unknown"))
        .when(kind0 == "BinaryBits", F.lit("Binary"))
        .when(kind0 == "VarbinaryBits", F.lit("Varbinary"))
        # document stores know whole names only
        .when(q(engine).isin("MongoDb", "CosmosDb") & (base != F.col("__text")), F.lit("Unknown"))
        .otherwise(F.coalesce(kind0, F.lit("Unknown")))
    )
    raw = (
        F.when(kind0 == "UnknownBase", base)
        .when((kind0 == "UnknownNull") & (base == F.col("__text")), F.lit("null"))
        .otherwise(F.col("__text"))
    )
    bits = F.coalesce(F.ceil(p1 / 8).cast("bigint"), F.lit(1))
    p = (
        F.when(oracle_number, F.coalesce(_byte(p1), F.lit(38)))
        .when(kind0.endswith("Bits"), bits)
        .otherwise(F.coalesce(F.col("__fp"), p1, F.col("__dp")))
    )
    s = F.when(oracle_number, F.when(p2 > 0, p2).otherwise(0)).otherwise(F.coalesce(F.col("__fs"), p2, F.col("__ds")))
    sized = F.col("__kind1").isin("Decimal", "Char", "Varchar", "NChar", "NVarchar", "Binary", "Varbinary")
    decimal = F.col("__kind1") == "Decimal"
    staged = joined.withColumns({"__kind1": kind, "__p1": p, "__s1": s, "__raw1": raw})
    unknown = F.col("__kind1") == "Unknown"
    result = F.struct(
        F.col("__kind1").alias("kind"),
        F.when(decimal, _byte(F.col("__p1"))).when(sized, F.col("__p1")).alias("p"),
        F.when(decimal, _byte(F.col("__s1"))).alias("s"),
        F.col("__depth").alias("depth"),
        F.when(unknown, F.col("__raw1")).alias("raw"),
    )
    return staged.select(*[q(c) for c in names if c != out], result.alias(out))


def canonical_text(c: Column) -> Column:
    """``Decimal(18,2)``, ``Array<Int>``, ``Unknown(geometry)`` and so on."""
    inner = (
        F.when(c["kind"] == "Unknown", F.concat(F.lit("Unknown("), c["raw"], F.lit(")")))
        .when(c["s"].isNotNull(), F.concat(c["kind"], F.lit("("), c["p"].cast("string"), F.lit(","), c["s"].cast("string"), F.lit(")")))
        .when(c["p"].isNotNull(), F.concat(c["kind"], F.lit("("), c["p"].cast("string"), F.lit(")")))
        .otherwise(c["kind"])
    )
    return F.concat(F.repeat(F.lit("Array<"), c["depth"]), inner, F.repeat(F.lit(">"), c["depth"]))


def render_type(df: DataFrame, engine: str, canonical: str = "canonical", out: str = "target_type") -> DataFrame:
    """Add the native type text of the engine named in column ``engine``."""
    rules = F.broadcast(df.sparkSession.createDataFrame(R.render_rules(), "__engine string, __kind string, __template string"))
    c, names = q(canonical), df.columns
    nested = (c["depth"] > 0) & (q(engine) != "PostgreSql")
    kind = F.when(nested, F.lit("Array")).otherwise(c["kind"])
    joined = df.withColumn("__k", kind).join(
        rules, (q(engine) == F.col("__engine")) & (F.col("__k") == F.col("__kind")), "left_outer"
    )
    filled = F.replace(F.col("__template"), F.lit("{p}"), F.coalesce(c["p"].cast("string"), F.lit("")))
    filled = F.replace(filled, F.lit("{s}"), F.coalesce(c["s"].cast("string"), F.lit("")))
    unknown = F.when(q(engine).isin(*R.KEEPS_UNKNOWN), c["raw"]).otherwise(F.upper(c["raw"]))
    text = F.when(F.col("__k") == "Unknown", unknown).otherwise(filled)
    text = F.when(nested, text).otherwise(F.concat(text, F.repeat(F.lit("[]"), c["depth"])))
    return joined.select(*[q(x) for x in names if x != out], text.alias(out))


def _findings(src: Column, back: Column) -> list[tuple[Column, Column, bool]]:
    """(condition, message, lossy) for a mapping whose target reads back as ``back``."""
    flat = src["depth"] == 0
    becomes = lambda *kinds: (back["depth"] == 0) & back["kind"].isin(*kinds)
    text = lambda s: F.lit(s)
    decimal = flat & (src["kind"] == "Decimal")
    return [
        (
            decimal & becomes("Float", "Double"),
            F.format_string("DECIMAL(%d,%d) mapped to floating point; precision loss possible", src["p"], src["s"]),
            True,
        ),
        (
            decimal & becomes("Decimal") & ((back["p"] < src["p"]) | (back["s"] < src["s"])),
            F.format_string(
                "Target DECIMAL(%d,%d) has less precision than source DECIMAL(%d,%d)", back["p"], back["s"], src["p"], src["s"]
            ),
            True,
        ),
        (flat & (src["kind"] == "BigInt") & becomes("Int"), text("BIGINT mapped to INT; overflow possible for large values"), True),
        (
            flat & src["kind"].isin("DateTime", "Timestamp") & becomes("Text"),
            text("DateTime/Timestamp mapped to TEXT; type safety lost in target"),
            True,
        ),
        (
            flat & src["kind"].isin("NVarchar", "NChar", "NText") & becomes("Varchar", "Char", "Text"),
            text("Unicode type mapped to non-Unicode type; character loss possible"),
            True,
        ),
        (flat & (src["kind"] == "Json") & becomes("Text", "NText"), text("JSON mapped to text type; JSON validation lost in target"), False),
        (
            flat & (src["kind"] == "Uuid") & becomes("Text", "Varchar", "Char"),
            text("UUID mapped to string type; UUID validation lost in target"),
            False,
        ),
        (flat & (src["kind"] == "Unknown"), F.concat(text("Unknown source type '"), src["raw"], text("'; mapped as-is")), False),
    ]


def map_types(
    df: DataFrame,
    source_engine: str = "source_engine",
    target_engine: str = "target_engine",
    data_type: str = "data_type",
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Add ``canonical, target_type, warnings, is_lossy`` to rows of native types.

    ``overrides(source_engine, source_type, target_type)`` replaces the computed
    target type where it names the pair.

    Every distinct (engine, engine, type) is worked out once, then joined back;
    distinct combines in the map tasks, so common types cost nothing extra.
    """
    keys = [source_engine, target_engine, data_type]
    mapped = _mapped(df.select(*[q(k) for k in keys]).distinct(), *keys, overrides)
    renamed = mapped.select(
        *[q(k).alias(f"__j{i}") for i, k in enumerate(keys)], "canonical", "target_type", "warnings", "is_lossy"
    )
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & q(k).eqNullSafe(F.col(f"__j{i}"))
    return df.join(renamed, condition, "left_outer").drop("__j0", "__j1", "__j2")


def _mapped(df: DataFrame, source_engine: str, target_engine: str, data_type: str, overrides: DataFrame | None) -> DataFrame:
    out = render_type(canonicalise(df, source_engine, data_type), target_engine)
    if overrides is not None:
        chosen = overrides.select(
            F.col("source_engine").alias("__oe"), _squeeze(F.col("source_type")).alias("__ot"), F.col("target_type").alias("__target")
        )
        # one override per pair, so no input row is doubled
        chosen = chosen.groupBy("__oe", "__ot").agg(F.min("__target").alias("__target"))
        names = [c for c in out.columns if c != "target_type"]
        out = out.join(chosen, (q(source_engine) == F.col("__oe")) & (_squeeze(q(data_type)) == F.col("__ot")), "left_outer").select(
            *[q(c) for c in names], F.coalesce("__target", "target_type").alias("target_type")
        )
    back = canonicalise(out, target_engine, "target_type", "__back")
    findings = _findings(F.col("canonical"), F.col("__back"))
    warnings = F.array_compact(F.array(*[F.when(condition, message) for condition, message, _ in findings]))
    lossy = F.lit(False)
    for condition, _, is_lossy in findings:
        if is_lossy:
            lossy = lossy | F.coalesce(condition, F.lit(False))
    return back.select("*", warnings.alias("warnings"), lossy.alias("is_lossy")).drop("__back")


# -- typed casts of data ------------------------------------------------------------
_SPARK = {
    "Boolean": T.BooleanType(), "TinyInt": T.ShortType(), "SmallInt": T.ShortType(), "Int": T.IntegerType(), "BigInt": T.LongType(),
    "Float": T.FloatType(), "Double": T.DoubleType(), "Binary": T.BinaryType(), "Varbinary": T.BinaryType(), "Blob": T.BinaryType(),
    "Date": T.DateType(), "DateTime": T.TimestampNTZType(), "Timestamp": T.TimestampType(),
}


def spark_type(kind: str, p: int | None = None, s: int | None = None) -> T.DataType:
    """The Spark type that carries a canonical kind; text for everything else."""
    if kind == "Decimal":
        return T.DecimalType(min(p or 18, 38), min(s or 0, min(p or 18, 38)))
    return _SPARK.get(kind, T.StringType())


# What the whole-number kinds hold; a tiny integer differs by engine.
_WHOLE = {"TinyInt": (-(2**7), 2**8 - 1), "SmallInt": (-(2**15), 2**15 - 1), "Int": (-(2**31), 2**31 - 1), "BigInt": (-(2**63), 2**63 - 1)}
_TINY = {"SqlServer": (0, 2**8 - 1), "MySql": (-(2**7), 2**7 - 1)}
_SIZED_TEXT = ("Char", "Varchar", "NChar", "NVarchar")


def whole_limits(kind: str, engine: str | None = None) -> tuple[int, int] | None:
    """What a whole-number kind holds in an engine; without one a tiny integer holds what any engine's does."""
    return _TINY.get(engine, _WHOLE[kind]) if kind == "TinyInt" else _WHOLE.get(kind)


def _cast(c: Column, dtype: T.DataType, kind: str, p: int | None, s: int | None, engine: str | None = None) -> Column:
    wanted = spark_type(kind, p, s)
    if isinstance(wanted, T.BinaryType) and not isinstance(dtype, (T.BinaryType, T.StringType)):
        c, dtype = cell_text(c, dtype), T.StringType()  # the bytes of what the cell shows
    if isinstance(wanted, T.StringType) and isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        c, dtype = cell_text(c, dtype), T.StringType()
    out = held(c, dtype, wanted)
    limits = whole_limits(kind, engine)
    if isinstance(dtype, T.NumericType):
        # a failing try_cast raises and catches an error per row, so plain misfits are sorted out before
        if isinstance(wanted, T.DecimalType):
            out = F.when(F.abs(c) <= F.lit(float(10 ** (wanted.precision - wanted.scale))), out)
        elif limits and kind != "BigInt":
            out = F.when((c > limits[0] - 1) & (c < limits[1] + 1), out)
    elif kind == "TinyInt":  # carried by a wider type
        out = F.when((out >= limits[0]) & (out <= limits[1]), out)
    return F.left(out, F.lit(p)) if kind in _SIZED_TEXT and p else out


def _losses(c: Column, dtype: T.DataType, kind: str, p: int | None, s: int | None, engine: str | None = None) -> dict[str, Column]:
    """Conditions under which a cell loses something when cast."""
    present, cast = c.isNotNull(), _cast(c, dtype, kind, p, s, engine)
    losses = {"overflow": present & cast.isNull()}
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)) and kind in (*_WHOLE, "Decimal"):
        # decimals are compared as decimals, as a double tells only 15 digits apart
        back = held(cast, spark_type(kind, p, s), dtype) if isinstance(dtype, T.DecimalType) else cast.cast("double")
        losses["decimals_lost"] = present & cast.isNotNull() & ~back.eqNullSafe(c if isinstance(dtype, T.DecimalType) else c.cast("double"))
    if kind in _SIZED_TEXT and p:
        losses["truncated"] = F.length(cell_text(c, dtype)) > p
    if kind in ("Char", "Varchar", "Text") and isinstance(dtype, T.StringType):
        losses["non_ascii"] = c.rlike(r"[^\x00-\x7F]")
    return losses


def cast_loss_audit(df: DataFrame, mapping: Sequence[tuple[str, str, int | None, int | None]], by: Sequence[str] = (), engine: str | None = None) -> DataFrame:
    """Rows per column that would lose something: one pass over the data.

    ``mapping`` holds ``(column, canonical kind, p, s)``.  Output: ``column_name,
    overflow, decimals_lost, truncated, non_ascii``, for every value of the columns ``by``.
    """
    kinds = ("overflow", "decimals_lost", "truncated", "non_ascii")
    aggs, rows = [], []
    for i, (name, kind, p, s) in enumerate(mapping):
        found = _losses(q(name), df.schema[name].dataType, kind, p, s, engine)
        for k in kinds:
            aggs.append(F.count_if(found[k]).alias(f"{i}_{k}") if k in found else F.lit(0).cast("long").alias(f"{i}_{k}"))
        rows.append(F.struct(F.lit(name).alias("column_name"), *[q(f"{i}_{k}").alias(k) for k in kinds]))
    return df.groupBy(*[q(c) for c in by]).agg(*aggs).select(*[q(c) for c in by], F.inline(F.array(*rows)))


def cast_rows(df: DataFrame, mapping: Sequence[tuple[str, str, int | None, int | None]], engine: str | None = None) -> DataFrame:
    """``source`` (the row as it came), ``row`` (in target types) and ``reasons``: a note for every cell that does not fit."""
    wanted = {name: (kind, p, s) for name, kind, p, s in mapping}
    cells, notes = [], []
    for f in df.schema:
        if f.name not in wanted:
            cells.append(q(f.name))
            continue
        kind, p, s = wanted[f.name]
        cells.append(_cast(q(f.name), f.dataType, kind, p, s, engine).alias(f.name))
        size = f"({p},{s})" if s is not None else f"({p})" if p is not None else ""
        notes.append(F.when(_losses(q(f.name), f.dataType, kind, p, s, engine)["overflow"], F.lit(f"{f.name}: no {kind}{size}")))
    reasons = F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")
    return df.select(F.struct(*[q(c) for c in df.columns]).alias("source"), F.struct(*cells).alias("row"), reasons.alias("reasons"))


def cast_to(df: DataFrame, mapping: Sequence[tuple[str, str, int | None, int | None]], engine: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table in target types, and the rows with a cell that does not fit (as they came)."""
    rows = cast_rows(df, mapping, engine)
    return rows.filter(F.size("reasons") == 0).select("row.*"), rows.filter(F.size("reasons") > 0).select("source.*")


def cast_plan(spark: SparkSession, native: Mapping[str, str], source_engine: str, target_engine: str, overrides: DataFrame | None = None) -> list[tuple[str, str, int | None, int | None]]:
    """The mapping that casts a table of native column types to the types these become in another engine.

    Native to canonical, to the target's native type, and what that reads back as: the limits are
    those of the type that the target really has. A row a column; arrays are carried as text.
    """
    if not native:
        return []
    columns = spark.createDataFrame([(i, t, source_engine, target_engine) for i, t in enumerate(native.values())], "i int, data_type string, source_engine string, target_engine string")
    mapped = map_types(columns, "source_engine", "target_engine", "data_type", overrides).drop("canonical")
    back = {r.i: r.canonical for r in canonicalise(mapped, "target_engine", "target_type").select("i", "canonical").collect()}
    large = 2**31 - 1  # what ``max`` and the like read as
    return [
        (name, "Text", None, None) if back[i].depth else (name, back[i].kind, back[i].p if (back[i].p or 0) < large else None, back[i].s)
        for i, name in enumerate(native)
    ]


def cast_by_type_map(df: DataFrame, native: Mapping[str, str], source_engine: str, target_engine: str, overrides: DataFrame | None = None) -> DataFrame:
    """``cast_rows`` of the columns in ``native`` to what the target engine makes of their types."""
    return cast_rows(df, cast_plan(df.sparkSession, native, source_engine, target_engine, overrides), target_engine)
