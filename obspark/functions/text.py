"""Scalar text functions: tokens, query terms, redaction, model-output parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accented letters of the supported languages and what they fold to.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy"

# Event name prefixes in the order in which they are tried, with their categories.
EVENT_CATEGORIES = (
    ("request", "request/queue"),
    ("task", "request/queue"),
    ("job", "job/scale"),
    ("scale", "job/scale"),
    ("unit", "job/scale"),
    ("frame", "pre-vlm local"),
    ("media", "pre-vlm local"),
    ("detector", "pre-vlm local"),
    ("vlm_scheduler", "scheduler wait"),
    ("vlm", "provider wall time"),
    ("model_call", "provider wall time"),
    ("publication", "post-vlm publication"),
    ("observation", "post-vlm publication"),
    ("audit", "post-vlm publication"),
)

# Keys and values that an export hides, and the longest value that it shows.
HIDDEN_KEYS = "(?i)(authorization|api[_-]?key|token|secret|password|credential|source[_-]?uri|source[_-]?path|raw[_-]?media|base64|image[_-]?bytes|frame[_-]?bytes|uri|url|path)"
HIDDEN_PATH = r"^(/|[A-Za-z]:[\\/])"
MOST_SHOWN = 2048

# What the event recorder replaces in strings, and the longest string that it keeps.
DATA_URL = r"data:[^\s'\"]+;base64,[A-Za-z0-9+/=]+"
LONG_BASE64 = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{120,}={0,2}"
UNIX_PATH = r"/(?:[^\s'\"<>:]+/)+[^\s'\"<>:]+"
MOST_RECORDED = 500
# Parts of keys, without other marks than letters and digits, whose values it never keeps.
RECORDED_HIDDEN = ("authorization", "apikey", "token", "secret", "password", "uri", "url", "path", "base64", "rawmedia", "rawimage", "rawvideo")

# Names and message parts by which errors are told apart.
PROVIDER_ERROR = "VlmProviderError"
SCHEMA_ERRORS = ("VlmSchemaValidationError", "ModelOutputSchemaValidationError")
PERMANENT_STORAGE_ERRORS = ("IntegrityError", "DataError", "ProgrammingError")
TRANSIENT_STORAGE_MARKS = ("operationalerror", "database is locked", "database table is locked", "busy", "timeout")


def folded(c: Column | str) -> Column:
    """a text in lower case, without accents."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.when(F.octet_length(low) > F.length(low), F.translate(low, ACCENTED, PLAIN)).otherwise(low)


def runs(c: Column) -> Column:
    """runs of letters and digits."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens(c: Column | str) -> Column:
    """folded tokens, runs of letters and digits."""
    return runs(folded(c))


def query_terms(query: str) -> list[str]:
    """lower-cased terms between blanks and commas; a term with anything but letters and digits is dropped."""
    return [t for t in query.lower().replace(",", " ").split() if t.isalnum()]


def keyword_score(c: Column | str, terms: list[str]) -> Column:
    """how many query terms are substrings (repeated terms count again)."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return sum((F.coalesce(F.contains(low, F.lit(t)).cast("int"), F.lit(0)) for t in terms), F.lit(0))


def event_category(c: Column, categories: Sequence[tuple[str, str]] = EVENT_CATEGORIES) -> Column:
    """category of the first prefix that an event name starts with, else ``other``."""
    return F.coalesce(*[F.when(F.startswith(c, F.lit(prefix)), category) for prefix, category in categories], F.lit("other"))


def redacted(key: Column, value: Column) -> Column:
    """what an export shows of a string: nothing of hidden keys, embedded data, absolute paths and very long strings."""
    return F.when(key.rlike(HIDDEN_KEYS) | F.startswith(value, F.lit("data:")) | value.rlike(HIDDEN_PATH), "[redacted]").when(F.length(value) > MOST_SHOWN, "[redacted-long-string]").otherwise(value)


def recorded(c: Column) -> Column:
    """F16: a string as the event recorder keeps it: embedded data replaced, paths down to their last part, cut to a length."""
    text = F.regexp_replace(F.regexp_replace(c, DATA_URL, "<redacted-data-url>"), LONG_BASE64, "<redacted-base64>")
    # closing marks go with the path that they end
    text = F.regexp_replace(text, rf"(?={UNIX_PATH})/(?:[^\s'\"<>:]+/)+([^\s'\"<>:/]*?)[).,;\]]*(?=[\s'\"<>:]|$)", "<path:$1>")
    text = F.replace(text, F.lit("<path:>"), F.lit("<path:redacted>"))
    return F.when(F.length(text) > MOST_RECORDED, F.concat(F.substring(text, 1, MOST_RECORDED), F.lit("...<truncated>"))).otherwise(text)


def recorded_fields(c: Column) -> Column:
    """F16: a map of strings as the event recorder keeps it."""
    plain = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    return F.transform_values(c, lambda k, v: F.when(plain(k).rlike("|".join(RECORDED_HIDDEN)), "<redacted>").otherwise(recorded(v)))


#: Elements of a list that the event recorder keeps.
MOST_LISTED = 100


def recorded_json(c: Column, kind: T.DataType) -> Column:
    """F16: a nested value (strings, numbers, truth values, and structs, string-keyed maps and lists of them) as the event recorder keeps it, as JSON.

    Values of hidden keys are replaced at every depth, strings are cleaned, lists are cut. Null is ``null``.
    """
    quoted = lambda s: F.substring(F.to_json(F.struct(s.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(s.alias("v")))) - 6)
    hides = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "").rlike("|".join(RECORDED_HIDDEN))
    pair = lambda k, v: F.concat(quoted(k), F.lit(":"), F.when(hides(k), F.lit('"<redacted>"')).otherwise(v))
    if isinstance(kind, T.StringType):
        out = quoted(recorded(c))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(F.slice(c, 1, MOST_LISTED), lambda x: recorded_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_keys(c)), lambda k: pair(k, recorded_json(F.try_element_at(c, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = [pair(F.lit(f.name), recorded_json(c[f.name], f.dataType)) for f in kind.fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        out = c.cast("string")
    return F.when(c.isNull(), "null").otherwise(out)


def model_json(c: Column) -> Column:
    """the outermost object of a model's answer, code fences and prose around it left out (null if there is none)."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def model_status(c: Column) -> Column:
    """empty, no_json, invalid_json or ok."""
    body = model_json(c)
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty").when(body.isNull(), "no_json").when(F.try_parse_json(body).isNull(), "invalid_json").otherwise("ok")


def model_failure(classes: Column) -> Column:
    """code of a failed model call by the names of the error's class and of the classes that it derives from (the own one first)."""
    own = F.coalesce(F.get(classes, 0), F.lit(""))
    schema = F.arrays_overlap(classes, F.array(*map(F.lit, SCHEMA_ERRORS)))
    return F.when(F.contains(F.lower(own), F.lit("provider")), "vlm_provider_error").when(schema, "vlm_schema_validation_failed").otherwise("analysis_unit_failed")


def model_retries(classes: Column) -> Column:
    """whether a failed model call may be tried again: only errors of the provider, whatever derives from them."""
    return F.coalesce(F.array_contains(classes, PROVIDER_ERROR), F.lit(False))


def storage_retries(classes: Column, message: Column) -> Column:
    """whether a failed write may be tried again: a mark of a busy store, but no permanent error."""
    said = F.lower(F.concat_ws(": ", F.coalesce(F.get(classes, 0), F.lit("")), F.coalesce(message, F.lit(""))))
    marked = F.exists(F.array(*map(F.lit, TRANSIENT_STORAGE_MARKS)), lambda m: F.contains(said, m))
    return marked & ~F.coalesce(F.arrays_overlap(classes, F.array(*map(F.lit, PERMANENT_STORAGE_ERRORS))), F.lit(False))


def shown_number(c: Column) -> Column:
    """a number as reports show it: whole ones (to 1e-9) without a point, others to six significant digits; n/a for null."""
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", c), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(c.isNull(), "n/a").when(F.abs(c - F.rint(c)) < 1e-9, F.rint(c).cast("bigint").cast("string")).otherwise(digits)
