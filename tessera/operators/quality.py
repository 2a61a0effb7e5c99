"""Schema and contract validation as generated expressions, and dataset metrics in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType,
    "int": T.IntegralType,
    "number": T.NumericType,
    "list": T.ArrayType,
    "map": (T.StructType, T.MapType),
    "boolean": T.BooleanType,
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}

_CHECKSUM = {"type": "string", "pattern": "^[a-f0-9]{64}$"}
_STATUS = {"type": "string", "enum": ["pending", "processing", "completed", "failed"]}
_OPTIONAL = {"type": "string", "optional": True}
# The named schemas.
SCHEMAS: dict[str, dict] = {
    "document": {
        "required": ["source", "source_type", "checksum", "processing_status"],
        "fields": {
            "source": {"type": "string", "min_length": 1},
            "source_type": {"type": "string", "enum": ["document", "email", "calendar", "gmail"]},
            "checksum": _CHECKSUM,
            "title": _OPTIONAL,
            "content": _OPTIONAL,
            "processing_status": _STATUS,
            "mime_type": _OPTIONAL,
            "size_bytes": {"type": "int", "optional": True, "min": 0},
        },
    },
    "communication": {
        "required": ["source", "source_type", "checksum", "processing_status"],
        "fields": {
            "source": {"type": "string", "min_length": 1},
            "source_type": {"type": "string", "enum": ["email", "gmail"]},
            "checksum": _CHECKSUM,
            "subject": _OPTIONAL,
            "body": _OPTIONAL,
            "sender_email": _OPTIONAL,
            "processing_status": _STATUS,
        },
    },
    "event": {
        "required": ["source", "source_type", "checksum"],
        "fields": {
            "source": {"type": "string", "min_length": 1},
            "source_type": {"type": "string", "enum": ["calendar_event", "google_calendar"]},
            "checksum": _CHECKSUM,
            "title": _OPTIONAL,
            "description": _OPTIONAL,
            "start_time": {"type": "datetime", "optional": True},
            "end_time": {"type": "datetime", "optional": True},
        },
    },
    "gold_node": {
        "required": ["type", "source_ref"],
        "fields": {
            "type": {"type": "string", "enum": ["document", "communication", "activity", "agent", "resource", "event"]},
            "subtype": _OPTIONAL,
            "name": _OPTIONAL,
            "content": _OPTIONAL,
            "source_ref": {"type": "map"},
            "status": {"type": "string", "enum": ["active", "inactive", "archived", "confirmed", "tentative"]},
            "confidence": {"type": "number", "optional": True, "min": 0, "max": 1},
        },
    },
    "gold_edge": {
        "required": ["source_node_id", "target_node_id", "predicate"],
        "fields": {
            "source_node_id": {"type": "string"},
            "target_node_id": {"type": "string"},
            "predicate": {"type": "string", "min_length": 1},
            "weight": {"type": "number", "optional": True, "min": 0, "max": 1},
        },
    },
    "chunk": {
        "required": ["parent_node_id", "content", "chunk_index"],
        "fields": {
            "parent_node_id": {"type": "string"},
            "content": {"type": "string", "min_length": 1},
            "chunk_index": {"type": "int", "min": 0},
            "embedding": {"type": "list", "optional": True},
        },
    },
}

# The contracts between layers; ``each`` fields are checked for every element.
CONTRACTS: dict[str, list[dict]] = {
    "bronze_to_silver": [
        {"name": "id", "required": True, "pattern": "^[a-zA-Z0-9]+$", "severity": "critical"},
        {"name": "threadId", "required": True, "pattern": "^[a-zA-Z0-9]+$", "severity": "critical"},
        {"name": "payload.mimeType", "required": True, "severity": "high", "enum": ["text/plain", "text/html", "multipart/mixed", "multipart/alternative", "multipart/related", "application/pdf", "application/octet-stream"]},
        {"name": "payload.headers", "required": True, "min_items": 3, "severity": "critical"},
        {"name": "payload.headers", "each": "name", "severity": "medium"},
        {"name": "payload.headers", "each": "value", "severity": "medium"},
    ],
    "silver_to_gold": [
        {"name": "type", "required": True, "severity": "critical", "enum": ["document", "communication", "activity", "agent", "resource", "event"]},
        {"name": "source_ref", "required": True, "severity": "critical"},
        {"name": "source_ref.table", "required": True, "severity": "critical", "enum": ["documents", "communications", "events"]},
        {"name": "source_ref.id", "required": True, "severity": "critical"},
        {"name": "source_ref.checksum", "required": True, "pattern": "^[a-f0-9]{64}$", "severity": "critical"},
        {"name": "name", "min_length": 1, "severity": "medium"},
        {"name": "embedding_text", "required": True, "min_length": 10, "severity": "medium"},
        {"name": "confidence", "min": 0.0, "max": 1.0, "severity": "medium"},
        {"name": "status", "enum": ["active", "inactive", "archived"], "severity": "medium"},
    ],
    "gold_to_rag": [
        {"name": "id", "required": True, "severity": "medium"},
        {"name": "parent_node_id", "required": True, "severity": "critical"},
        {"name": "parent_type", "required": True, "enum": ["document", "communication", "activity"], "severity": "high"},
        {"name": "content", "required": True, "min_length": 10, "max_length": 10000, "severity": "critical"},
        {"name": "chunk_index", "required": True, "min": 0, "severity": "medium"},
        {"name": "chunk_count", "min": 1, "severity": "medium"},
        {"name": "embedding", "min_items": 384, "max_items": 384, "severity": "critical"},
    ],
}


def _field(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def _rules(c: Column, rule: dict, kind: T.DataType) -> list[tuple[Column, str]]:
    """Conditions under which a present value breaks the rule, with what to say."""
    out = []
    if isinstance(kind, T.StringType):
        if "min_length" in rule:
            out.append((F.length(c) < rule["min_length"], f"shorter than {rule['min_length']}"))
        if "max_length" in rule:
            out.append((F.length(c) > rule["max_length"], f"longer than {rule['max_length']}"))
        if "pattern" in rule:
            out.append((~c.rlike(rule["pattern"]), "doesn't match its pattern"))
    if isinstance(kind, T.ArrayType):
        if "min_items" in rule:
            out.append((F.size(c) < rule["min_items"], f"fewer than {rule['min_items']} items"))
        if "max_items" in rule:
            out.append((F.size(c) > rule["max_items"], f"more than {rule['max_items']} items"))
    if "enum" in rule:
        out.append((~c.isin(*rule["enum"]), "not one of its values"))
    if isinstance(kind, T.NumericType):
        if "min" in rule:
            out.append((c < rule["min"], f"below {rule['min']}"))
        if "max" in rule:
            out.append((c > rule["max"], f"above {rule['max']}"))
    return out


def schema_errors(df: DataFrame, spec: dict | str) -> Column:
    """Array of errors of each row against a schema (a name of SCHEMAS or a specification).

    A field of the wrong type is named once, and its other rules rest; a column that is missing and
    isn't optional is an error of every row.
    """
    spec = SCHEMAS[spec] if isinstance(spec, str) else spec
    checks: list[Column] = []
    for name in spec["required"]:
        kind = _field(df.schema, name)
        if kind is None:
            checks.append(F.lit(f"{name}: required"))
        else:
            c = F.col(name)
            blank = c.isNull() | (F.trim(c) == "") if isinstance(kind, T.StringType) else c.isNull()
            checks.append(F.when(blank, F.lit(f"{name}: required")))
    for name, rule in spec["fields"].items():
        kind = _field(df.schema, name)
        if kind is None:
            if not rule.get("optional") and name not in spec["required"]:
                checks.append(F.lit(f"{name}: missing"))
            continue
        if not isinstance(kind, _KINDS[rule["type"]]):
            checks.append(F.when(F.col(name).isNotNull(), F.lit(f"{name}: not a {rule['type']}")))
            continue
        checks += [F.when(F.col(name).isNotNull() & bad, F.lit(f"{name}: {said}")) for bad, said in _rules(F.col(name), rule, kind)]
    return F.array_compact(F.array(*checks, F.lit(None).cast("string")))


def validation(*validators: Callable[[DataFrame], tuple[list[Column], list[Column]]]):
    """A step for ``DataFrame.transform``: the column validation, a struct of is_valid, errors and warnings,
    from any number of validators, functions of the rows to expressions that are a message or null."""

    def step(df: DataFrame) -> DataFrame:
        found = [v(df) for v in validators]
        said = [F.array_compact(F.array(*(c for f in found for c in f[k]), F.lit(None).cast("string"))) for k in (0, 1)]
        return df.withColumn("validation", F.struct((F.size(said[0]) == 0).alias("is_valid"), said[0].alias("errors"), said[1].alias("warnings")))

    return step


def contract_violations(df: DataFrame, contract: list[dict] | str) -> Column:
    """Array of structs (field, severity, message) of each row against a contract.

    Paths lead through structs; ``each`` names a part that every element of an array must have.
    """
    contract = CONTRACTS[contract] if isinstance(contract, str) else contract
    out: list[Column] = []

    def said(condition: Column | None, rule: dict, message: str) -> None:
        made = F.struct(F.lit(rule["name"]).alias("field"), F.lit(rule.get("severity", "medium")).alias("severity"), F.lit(message).alias("message"))
        out.append(made if condition is None else F.when(condition, made))

    for rule in contract:
        kind = _field(df.schema, rule["name"])
        if kind is None:
            if rule.get("required"):
                said(None, rule, "required")
            continue
        c = F.col(rule["name"])
        if rule.get("each"):
            part = rule["each"]
            said(F.exists(F.transform(c, lambda x: x[part]), lambda x: x.isNull()), rule, f"an element without {part}")  # noqa: B023
            continue
        if rule.get("required"):
            said(c.isNull(), rule, "required")
        for bad, message in _rules(c, rule, kind):
            said(c.isNotNull() & bad, rule, message)
    return F.array_compact(F.array(*out))


def blocking(violations: Column) -> Column:
    """Whether one of the violations is critical or high."""
    return F.exists(violations, lambda v: v["severity"].isin("critical", "high"))


def split_blocked(df: DataFrame, contract: list[dict] | str) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and those in quarantine with their violations."""
    checked = df.withColumn("violations", contract_violations(df, contract))
    blocked = F.coalesce(blocking(F.col("violations")), F.lit(False))
    return checked.filter(~blocked).drop("violations"), checked.filter(blocked)


def dataset_metrics(df: DataFrame, columns: list[str], unique: list[str]) -> DataFrame:
    """Null rate of columns and share of distinct values of others, in one pass."""
    n = F.greatest(F.count("*"), F.lit(1))
    return df.agg(F.count("*").alias("n_rows"), *[F.round(F.count_if(F.col(c).isNull()) / n, 6).alias(f"{c}_null_rate") for c in columns], *[F.round(F.count_distinct(c) / n, 6).alias(f"{c}_unique_rate") for c in unique])


def integrity(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows, rows whose key the other table lacks, and the share of those that are found."""
    found = other.select(F.col(other_key).alias("__k")).distinct().withColumn("__f", F.lit(1))
    both = df.select(F.col(key).alias("__d")).join(found, F.col("__d") == F.col("__k"), "left")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("__f").isNull()).alias("orphans"), F.round(F.count("__f") / F.greatest(F.count("*"), F.lit(1)), 6).alias("integrity"))


def embedding_validation(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Counts of valid, wrongly sized, corrupt and null vectors; good where over nine tenths are valid."""
    v = F.col(vector)
    corrupt = F.exists(v.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sized = v.isNotNull() & (F.size(v) == dimension)
    valid = F.count_if(sized & ~corrupt)
    return df.agg(F.count("*").alias("total"), valid.alias("valid"), F.count_if(v.isNotNull() & (F.size(v) != dimension)).alias("invalid_dim"), F.count_if(sized & corrupt).alias("corrupt"), F.count_if(v.isNull()).alias("null_vectors"), F.when(valid / F.greatest(F.count("*"), F.lit(1)) > 0.9, "good").otherwise("degraded").alias("health"))


def freshness(df: DataFrame, at: str, now, stale_hours: int = 24) -> DataFrame:
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(F.col(at).cast("timestamp")))) / 3600
    return df.agg(F.round(hours, 4).alias("age_hours")).withColumn("stale", F.col("age_hours") > stale_hours)


def drift(reference: DataFrame, current: DataFrame, vector: str) -> DataFrame:
    """Shift of the mean vectors and a stability index by dimension; dimensions without spread or
    mean are left out."""

    def moments(df: DataFrame, tag: str) -> DataFrame:
        rows = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
        return rows.groupBy("d").agg(F.avg("x").alias(f"m_{tag}"), F.stddev_pop("x").alias(f"s_{tag}"))

    both = moments(reference, "r").join(moments(current, "c"), "d")
    ref, cur = F.abs("m_r") / F.greatest(F.col("s_r"), F.lit(1e-10)), F.abs("m_c") / F.greatest(F.col("s_c"), F.lit(1e-10))
    psi = F.when((F.col("s_r") != 0) & (ref != 0) & (cur != 0), (cur - ref) * F.log(cur / ref))
    shift = F.sqrt(F.sum(F.pow(F.col("m_r") - F.col("m_c"), 2)))
    out = both.agg(F.coalesce(shift, F.lit(0.0)).alias("mean_shift"), F.coalesce(F.max(psi), F.lit(0.0)).alias("max_psi"), F.coalesce(F.avg(psi), F.lit(0.0)).alias("avg_psi"))
    return out.withColumn("drift_detected", (F.col("mean_shift") > 0.1) | (F.col("max_psi") > 0.2))
