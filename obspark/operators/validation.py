"""validation of model answers: repair, parse, and a declared schema over VARIANT, with errors by path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages at which an answer can fail, and how it can pass.
PARSE_FAILED, SHAPE_FAILED, SCHEMA_FAILED, REPAIRED, PASSED = "json_parse_failed", "json_shape_failed", "schema_validation_failed", "repair_succeeded", "passed"
# Keys that a model must not set.
FORBIDDEN = ("access_policy_id", "security_level", "camera_id", "location_id", "observed_start_time", "observed_end_time", "record_id")
# Strings that stand for truth values.
TRUTHS = ("true", "false", "1", "0", "t", "f", "y", "n", "yes", "no", "on", "off")

_ERRORS = "array<struct<path:string,type:string>>"


@dataclass(frozen=True)
class Text:
    """A string."""


@dataclass(frozen=True)
class Number:
    """A number, or a string or truth value that stands for one, within bounds."""

    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Flag:
    """A truth value, or 0, 1 or a word that stands for one."""


@dataclass(frozen=True)
class Listing:
    item: Text | Number | Flag | Listing | Record


@dataclass(frozen=True)
class Record:
    """Fields by name, of which some must be there; others are not allowed."""

    fields: dict = field(default_factory=dict)
    required: tuple[str, ...] = ()


# What a model answers about a segment.
OBSERVATION = Record(
    {"static": Text(), "dynamic": Text(), "tags": Listing(Text()), "quality": Record({"reason": Text(), "score": Number(0.0, 1.0)}), "attr": Record({"alert": Flag()})}, ("static", "dynamic")
)


def _none() -> Column:
    return F.array().cast(_ERRORS)


def _error(path: Column, name: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(name).alias("type"))).cast(_ERRORS)


def _fails(*cases: tuple[Column, str], path: Column) -> Column:
    """The error of the first case that holds, or none."""
    out = None
    for condition, name in cases:
        out = F.when(condition, _error(path, name)) if out is None else out.when(condition, _error(path, name))
    return out.otherwise(_none())


def _joined(path: Column | None, name: Column) -> Column:
    return name if path is None else F.concat(path, F.lit("."), name)


def errors(v: Column, spec, path: Column | None = None) -> Column:
    """Errors of a VARIANT that is there: an array of path (dots between names and positions) and type, fields in declared order, then what is too much."""
    kind = F.schema_of_variant(v)
    at = F.lit("") if path is None else path
    is_number = kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    if isinstance(spec, Text):
        return _fails((kind != "STRING", "string_type"), path=at)
    if isinstance(spec, Flag):
        said = F.lower(F.try_variant_get(v, "$", "string"))
        number = F.try_variant_get(v, "$", "double")
        ok = (kind == "BOOLEAN") | ((kind == "STRING") & said.isin(*TRUTHS)) | (is_number & number.isin(0.0, 1.0))
        return F.when(ok, _none()).otherwise(_fails(((kind == "STRING") | is_number, "bool_parsing"), (F.lit(True), "bool_type"), path=at))
    if isinstance(spec, Number):
        number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        cases = [((kind == "STRING") & number.isNull(), "float_parsing"), (~(is_number | kind.isin("STRING", "BOOLEAN")), "float_type")]
        cases += [(number < spec.low, "greater_than_equal")] if spec.low is not None else []
        cases += [(number > spec.high, "less_than_equal")] if spec.high is not None else []
        return _fails(*cases, path=at)
    if isinstance(spec, Listing):
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.flatten(F.transform(items, lambda x, i: errors(x, spec.item, _joined(path, i.cast("string")))))
        return F.when(F.startswith(kind, F.lit("ARRAY")), each).otherwise(_error(at, "list_type"))
    if isinstance(spec, Record):
        parts = []
        for name, inner in spec.fields.items():
            value, where = F.try_variant_get(v, f"$.{name}", "variant"), _joined(path, F.lit(name))
            absent = _error(where, "missing") if name in spec.required else _none()
            parts.append(F.when(value.isNull(), absent).otherwise(errors(value, inner, where)))
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        known = F.array(*map(F.lit, spec.fields)) if spec.fields else F.array().cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.struct(_joined(path, k).alias("path"), F.lit("extra_forbidden").alias("type")))
        return F.when(F.startswith(kind, F.lit("OBJECT")), F.concat(*parts, extra.cast(_ERRORS))).otherwise(_error(at, "model_type"))
    raise TypeError(f"no rule for {spec}")


def _unfenced(c: Column) -> tuple[Column, Column]:
    """A text without code fences around it, and what was done for it."""
    trimmed = F.regexp_replace(c, r"\A\s+|\s+\z", "")
    opens = F.startswith(trimmed, F.lit("```")) & F.contains(trimmed, F.lit("\n"))
    body = F.when(opens, F.regexp_replace(trimmed, r"\A[^\n]*\n", "")).otherwise(trimmed)
    closes = F.startswith(trimmed, F.lit("```")) & body.rlike(r"```\s*\z")
    done = F.array_compact(F.array(F.when(opens, F.lit("strip_code_fence_start")), F.when(closes, F.lit("strip_code_fence_end"))))
    return F.regexp_replace(F.when(closes, F.regexp_replace(body, r"```\s*\z", "")).otherwise(body), r"\A\s+|\s+\z", ""), done


def validated(answers: DataFrame, column: str, spec: Record = OBSERVATION, forbidden: Sequence[str] = FORBIDDEN) -> DataFrame:
    """Adds to answers (a string column; null counts as empty) what becomes of each: status, repair_attempted, repair_succeeded, repair_actions, errors, and payload (the repaired object as JSON, null if there is none).

    Code fences and prose around the outermost braces go, then forbidden keys of the object; what is left must satisfy the schema.
    An object that repeats a key can't be parsed.
    """
    body, fences = _unfenced(F.coalesce(F.col(column), F.lit("")))
    out = answers.withColumns({"_b": body, "_f": fences})
    inner = F.regexp_extract("_b", r"(?s)(\{.*\})", 1)
    out = out.withColumn("_j", F.when(inner != "", inner).otherwise(F.col("_b"))).withColumn("_f", F.when((inner != "") & (inner != F.col("_b")), F.array_append("_f", F.lit("extract_json_object"))).otherwise(F.col("_f")))
    out = out.withColumn("_v", F.try_parse_json("_j"))
    out = out.withColumn("_m", F.when(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.try_variant_get("_v", "$", "map<string,variant>")))
    hidden = F.array(*map(F.lit, forbidden)) if forbidden else F.array().cast("array<string>")
    gone = F.array_sort(F.array_intersect(F.map_keys("_m"), hidden))
    out = out.withColumn("repair_actions", F.concat("_f", F.coalesce(F.transform(gone, lambda k: F.concat(F.lit("strip_forbidden_field:"), k)), F.array().cast("array<string>"))))
    out = out.withColumn("payload", F.to_json(F.map_filter("_m", lambda k, _: ~F.array_contains(hidden, k)), {"ignoreNullFields": "false"}))
    out = out.withColumn("errors", F.when(F.col("_m").isNull(), _none()).otherwise(errors(F.try_parse_json("payload"), spec)))
    acted = F.size("repair_actions") > 0
    status = F.when(F.col("_v").isNull(), PARSE_FAILED).when(F.col("_m").isNull(), SHAPE_FAILED).when(F.size("errors") > 0, SCHEMA_FAILED).when(acted, REPAIRED).otherwise(PASSED)
    return out.withColumn("status", status).withColumn("repair_attempted", acted).withColumn("repair_succeeded", F.col("status") == REPAIRED).drop("_b", "_f", "_j", "_v", "_m")


def observation_values(checked: DataFrame) -> DataFrame:
    """Typed values of answers that passed, with the schema's defaults: static, dynamic, tags, reason, score, alert."""
    v = F.try_parse_json("payload")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    said = F.lower(get("$.attr.alert", "string"))
    ok = checked.filter(F.col("status").isin(PASSED, REPAIRED))
    return ok.withColumns({
        "static": get("$.static", "string"), "dynamic": get("$.dynamic", "string"), "tags": F.coalesce(get("$.tags", "array<string>"), F.array().cast("array<string>")), "reason": F.coalesce(get("$.quality.reason", "string"), F.lit("")),
        "score": F.coalesce(get("$.quality.score", "double"), F.lit(0.0)), "alert": F.coalesce(said.isin("true", "1", "t", "y", "yes", "on", "1.0"), F.lit(False)),
    })


def attempts(checked: DataFrame, key: Sequence[str]) -> DataFrame:
    """What the log of an attempt keeps: status, repairs, and errors as ``path:type``."""
    shown = F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["type"]))
    return checked.select(*key, "status", "repair_attempted", "repair_succeeded", "repair_actions", shown.alias("validation_errors"))


def error_counts(checked: DataFrame) -> DataFrame:
    """How often each error occurs, positions in lists left out: path, type, n."""
    each = checked.select(F.inline("errors")).withColumn("path", F.regexp_replace("path", r"(^|\.)\d+(?=\.|$)", "$1*"))
    return each.groupBy("path", "type").agg(F.count("*").alias("n"))
