"""Standardisation to the common event schema: projection, defaults, validation, coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import is_ip
from ..schema import ECS_CATEGORY, ECS_EVENT_TYPE, ECS_ORDER, ECS_TYPES, RAW_TO_ECS, UNIFIED_TO_ECS
from ..sources.logs import parse_time

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
KEYWORD_MOST, ERRORS_MOST, WARNINGS_MOST, VALUE_MOST = 10_000, 50, 20, 100


@dataclass
class Mapping:
    """What a projection mapped, from column names alone: no job runs."""

    total: int
    mapped: list[str]
    unmapped: list[str]
    defaults: list[str] = field(default_factory=list)

    @property
    def coverage(self) -> float:
        return 100.0 * len(self.mapped) / self.total if self.total else 0.0


def mapping_of(columns: list[str], source: str = "normalized") -> Mapping:
    table = UNIFIED_TO_ECS if source == "normalized" else RAW_TO_ECS
    mapped = [c for c in columns if c in table]
    return Mapping(len(columns), mapped, [c for c in columns if c not in table])


def category(dataset: Column) -> Column:
    """The event category of a dataset name; unknown and null ones are network."""
    table = F.create_map(*[F.lit(x) for kv in ECS_CATEGORY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(dataset)), F.lit("network"))


def project(df: DataFrame, source: str = "normalized", log_type: str | None = None, defaults: bool = True) -> tuple[DataFrame, Mapping]:
    """Renames the mapped fields, adds event.kind and event.category (event.type if the log type is given), casts and orders.

    Without a log type the category is each row's, from event.dataset. Times become text of fixed format, numbers long or double, null
    where they do not fit. Use single_log_type() to find the log type of a frame that has but one.
    """
    table, found = UNIFIED_TO_ECS if source == "normalized" else RAW_TO_ECS, mapping_of(df.columns, source)
    have = dict(df.dtypes)
    cols = {table[c]: coerced(F.col(f"`{c}`"), have[c], ECS_TYPES.get(table[c])) for c in found.mapped}
    if defaults:
        cols["event.kind"] = F.lit("event")
        found.defaults.append("event.kind")
        if log_type in ECS_CATEGORY:
            cols.setdefault("event.category", F.lit(ECS_CATEGORY[log_type]))
            cols.setdefault("event.type", F.lit(ECS_EVENT_TYPE[log_type]))
            found.defaults += ["event.category", "event.type"]
        else:
            dataset = next((c for c in found.mapped if table[c] == "event.dataset"), None)
            cols["event.category"] = category(F.col(f"`{dataset}`")) if dataset and log_type is None else F.lit("network")
            found.defaults.append("event.category")
    names = [c for c in ECS_ORDER if c in cols] + [c for c in cols if c not in ECS_ORDER]
    return df.select([cols[c].alias(c) for c in names]), found


def single_log_type(df: DataFrame) -> str | None:
    """The log type, if all rows have one and the same."""
    if "log_type" not in df.columns:
        return None
    kinds = [r[0] for r in df.select("log_type").distinct().limit(2).collect()]
    return kinds[0] if len(kinds) == 1 else None


def coerced(col: Column, have: str, kind: str | None) -> Column:
    if kind == "date":
        time = col if have.startswith("timestamp") else parse_time(col.cast("string"))
        return F.date_format(time, TIME_FORMAT)
    if kind in ("long", "port"):
        return col if have == "bigint" else col.try_cast("double").try_cast("long") if have == "string" else col.try_cast("long")
    if kind == "float":
        return col if have == "double" else col.try_cast("double")
    return col


def invalid(col: Column, have: str, kind: str) -> Column:
    """Whether a value breaks its type's rule; null never does."""
    text = col.cast("string")
    if kind == "ip":
        bad = ~is_ip(text)
    elif kind == "port":
        number = col.try_cast("double")
        bad = number.isNull() | ~F.floor(number).between(0, 65535)
    elif kind == "date":
        bad = F.lit(False) if have.startswith("timestamp") else F.coalesce(parse_time(text), F.try_to_timestamp(text)).isNull() & text.try_cast("double").isNull()
    elif kind == "keyword":
        bad = F.length(text) > KEYWORD_MOST
    elif kind in ("long", "float"):
        bad = F.lit(False) if have in ("int", "bigint", "smallint", "tinyint", "float", "double") else text.try_cast("long" if kind == "long" else "double").isNull()
    elif kind == "boolean":
        bad = F.lit(False) if have == "boolean" else ~text.isin("0", "1") if have in ("int", "bigint", "smallint", "tinyint") else F.lit(True)
    else:
        bad = F.lit(False)
    return col.isNotNull() & F.coalesce(bad, F.lit(True))


def checked(df: DataFrame) -> list[tuple[str, Column, str]]:
    have = dict(df.dtypes)
    return [(c, invalid(F.col(f"`{c}`"), have[c], ECS_TYPES[c]), ECS_TYPES[c]) for c in df.columns if c in ECS_TYPES]


def validation_counts(df: DataFrame, sample: int | None = None) -> DataFrame:
    """(field, expected_type, checked, errors) of all rows, in one aggregation; with sample, of that many rows."""
    rows = df.limit(sample) if sample else df
    found = checked(df)
    aggs = [F.struct(F.lit(c).alias("field"), F.lit(k).alias("expected_type"), F.count(F.col(f"`{c}`")).alias("checked"), F.count_if(bad).alias("errors")) for c, bad, k in found]
    return rows.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def validation_errors(df: DataFrame, most: int = ERRORS_MOST) -> DataFrame:
    """(field, expected_type, value): some of the offending values, at most `most`, for a report."""
    found = checked(df)
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(k).alias("expected_type"), F.substring(F.col(f"`{c}`").cast("string"), 1, VALUE_MOST).alias("value"), bad.alias("bad")) for c, bad, k in found])
    return df.select(F.explode(each).alias("e")).where("e.bad").select("e.field", "e.expected_type", "e.value").limit(most)


def coercion_warnings(df: DataFrame, most: int = WARNINGS_MOST) -> list[str]:
    """A line for each field of which values are lost when they are cast to the schema's types, with their number; at most `most` lines."""
    have = dict(df.dtypes)
    lost = {c: F.count_if(F.col(f"`{c}`").isNotNull() & coerced(F.col(f"`{c}`"), have[c], ECS_TYPES[c]).isNull()) for c in df.columns if c in ECS_TYPES}
    if not lost:
        return []
    row = df.agg(*[n.alias(f"x{k}") for k, n in enumerate(lost.values())]).first()
    return [f"{c}: {n} of its {have[c]} values do not fit {ECS_TYPES[c]} and become null" for c, n in zip(lost, row, strict=True) if n][:most]


def require_valid(df: DataFrame) -> DataFrame:
    """df, failing with an error at the first offending value of a run (the strict mode)."""
    have = dict(df.dtypes)
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in ECS_TYPES:
            message = F.concat(F.lit(f"validation error in {c}: "), F.coalesce(F.substring(col.cast("string"), 1, VALUE_MOST), F.lit("null")))
            col = F.when(invalid(col, have[c], ECS_TYPES[c]), F.raise_error(message).cast(have[c])).otherwise(col)
        out.append(col.alias(c))
    return df.select(out)


def report(source: DataFrame, ecs: DataFrame, found: Mapping) -> dict:
    """The validation report: coverage from names, the rest from one aggregation and one bounded sample."""
    counts = {r.field: r.errors for r in validation_counts(source_as_ecs(source, found)).collect()}
    errors = [r.asDict() for r in validation_errors(source_as_ecs(source, found)).collect()] if sum(counts.values()) else []
    ends = ecs.agg(F.min("`@timestamp`").alias("a"), F.max("`@timestamp`").alias("b")).first() if "@timestamp" in ecs.columns else None
    return {
        "total_source_fields": found.total, "mapped_fields": len(found.mapped), "unmapped_fields": found.unmapped, "mapping_coverage_pct": found.coverage,
        "fields_with_defaults": found.defaults, "timestamp_range": [ends.a, ends.b] if ends else None, "validation_error_count": sum(counts.values()),
        "errors_by_field": counts, "validation_errors": errors, "type_coercion_warnings": coercion_warnings(source_as_ecs(source, found)),
    }


def source_as_ecs(df: DataFrame, found: Mapping) -> DataFrame:
    """The source under its new names before any coercion, which is what validation judges."""
    table = UNIFIED_TO_ECS if all(c in UNIFIED_TO_ECS for c in found.mapped) else RAW_TO_ECS
    return df.select([F.col(f"`{c}`").alias(table[c]) for c in found.mapped])


def nested(ecs: DataFrame) -> DataFrame:
    """The dotted columns as nested structs, one for each first part of a name."""
    groups: dict[str, list[str]] = {}
    for c in ecs.columns:
        groups.setdefault(c.split(".", 1)[0], []).append(c)
    return ecs.select([F.col(f"`{cs[0]}`").alias(g) if cs == [g] else F.struct(*[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in cs]).alias(g) for g, cs in groups.items()])
