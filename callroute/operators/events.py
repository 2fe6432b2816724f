"""Event-side operators: classify, address, split control, quarantine, envelope.

All of them are narrow projections/filters plus one broadcast join against
the fixed 33-row message-type dimension, so the whole event pre-processing
runs in a single code-generated stage with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callroute.functions.jsonx import computed_once, fields_at, parse_messages, text_at, text_at_one_of
from callroute.sources.dims import MESSAGE_TYPES, NONE_RESOURCE, message_types

CHANNEL_VAR_PATH = "/channel/channelvars/CALL_CONTEXT"
CONTROL_TYPE = "APPLICATION_REPLACED"
CREATE_TYPE = "STASIS_START"
UNKNOWN_TYPE = "UNKNOWN"
ID_PATHS = sorted({p for _, _, _, p in MESSAGE_TYPES if p})
TYPE_PATH = "/type"
#: all that ``prepare_events`` reads of a message, read at once
FIELDS = {p: "string" for p in (TYPE_PATH, CHANNEL_VAR_PATH, *ID_PATHS)}


def _ensure_parsed(df: DataFrame) -> DataFrame:
    return df if "msg" in df.columns else parse_messages(df)


def _fields(df: DataFrame) -> Column | None:
    """The message's fields, where they are read already."""
    return F.col("_fields") if "_fields" in df.columns else None


def classify_events(df: DataFrame) -> DataFrame:
    """Wire type -> message type, resource type and id path (default UNKNOWN).

    ``has_type`` is false when the ``type`` field is absent altogether, which
    the protocol treats as a broken message (not as an unknown type).
    """
    df = _ensure_parsed(df)
    dim = F.broadcast(
        message_types(df.sparkSession).select(
            F.col("wire_type").alias("_wire"),
            F.col("type").alias("_type"),
            F.col("resource_type").alias("_rtype"),
            F.col("id_path").alias("_id_path"),
        )
    )
    wire_type = text_at(F.col("msg"), TYPE_PATH, _fields(df))
    # a type that has a text is there; of the others the value itself tells
    has_type = F.col("wire_type").isNotNull() | F.try_variant_get("msg", "$.type", "variant").isNotNull()
    typed = computed_once(computed_once(df, {"wire_type": wire_type}), {"has_type": has_type})
    joined = typed.join(dim, typed["wire_type"] == dim["_wire"], "left")
    return joined.withColumns(
        {
            "type": F.coalesce(F.col("_type"), F.lit(UNKNOWN_TYPE)),
            "resource_type": F.col("_rtype"),
            "id_path": F.col("_id_path"),
        }
    ).drop("_wire", "_type", "_rtype", "_id_path")


def resource_id_expr(msg: Column, id_path: Column, fields: Column | None = None) -> Column:
    """Text at the per-type id path (6 distinct paths)."""
    return text_at_one_of(msg, id_path, ID_PATHS, fields)


def extract_resource_id(df: DataFrame) -> DataFrame:
    """The resource id at the type's id path; NULL when absent or blank."""
    if "id_path" not in df.columns:
        df = classify_events(df)
    return computed_once(df, {"resource_id": resource_id_expr(F.col("msg"), F.col("id_path"), _fields(df))})


def channel_var_context(df: DataFrame) -> DataFrame:
    """P5: the CALL_CONTEXT channel variable, blank -> NULL."""
    df = _ensure_parsed(df)
    return computed_once(df, {"channel_var": text_at(F.col("msg"), CHANNEL_VAR_PATH, _fields(df))})


def context_policy(df: DataFrame) -> DataFrame:
    """StasisStart creates a context when missing; everything else only looks up."""
    if "type" not in df.columns:
        df = classify_events(df)
    return df.withColumn(
        "policy",
        F.when(F.col("type") == CREATE_TYPE, F.lit("CREATE_IF_MISSING")).otherwise(F.lit("LOOKUP_ONLY")),
    )


def prepare_events(df: DataFrame) -> DataFrame:
    """P1, P3-P6 in one projection chain: the parsed-event fixture shape."""
    df = _ensure_parsed(df)
    df = df.withColumn("_fields", fields_at(F.col("msg"), FIELDS))
    df = context_policy(extract_resource_id(classify_events(channel_var_context(df))))
    return df.drop("_fields")


def split_control(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data, control). Control messages (ApplicationReplaced) end the stream."""
    if "type" not in df.columns:
        df = classify_events(df)
    is_control = F.coalesce(F.col("type") == CONTROL_TYPE, F.lit(False))
    return df.filter(~is_control), df.filter(is_control)


def drop_reason(has_context: bool) -> Column:
    """Why an event is not routed (NULL when it is)."""
    reason = (
        F.when(F.col("malformed"), F.lit("malformed"))
        .when(~F.col("has_type"), F.lit("no_type"))
        .when(F.col("type") == CONTROL_TYPE, F.lit(None))
        .when(F.col("type") == UNKNOWN_TYPE, F.lit("unknown_type"))
        .when(F.col("id_path").isNull(), F.lit("not_routable"))
        .when(F.col("resource_id").isNull(), F.lit("no_resource_id"))
    )
    if has_context:
        reason = reason.when(F.col("call_context").isNull(), F.lit("no_context"))
    return reason.otherwise(F.lit(None)).cast("string")


def with_drop_reason(df: DataFrame) -> DataFrame:
    if "resource_id" not in df.columns:
        df = prepare_events(df)
    return df.withColumn("reason", drop_reason("call_context" in df.columns))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad). Bad rows carry ``reason``; a bad row never stops anything.

    Reasons: malformed, no_type, unknown_type, not_routable (a known type
    without an id path), no_resource_id, and no_context once contexts are
    resolved. Control messages are in neither output (see ``split_control``).
    """
    df = with_drop_reason(df)
    is_control = F.coalesce(F.col("type") == CONTROL_TYPE, F.lit(False)) & ~F.col("malformed")
    good = df.filter(F.col("reason").isNull() & ~is_control)
    bad = df.filter(F.col("reason").isNotNull())
    return good, bad


def event_resources(resource_type: Column, resource_id: Column) -> Column:
    """0 or 1 resources: a typed id, or none for types without a resource type (Dial)."""
    return F.filter(
        F.array(F.struct(resource_type.alias("type"), resource_id.alias("id"))),
        lambda r: r["type"].isNotNull(),
    )


def event_envelopes(df: DataFrame, commands_topic: str) -> DataFrame:
    """The event envelope as a struct column ``envelope`` (where the parsed ``msg`` is there) and JSON ``value``.

    Null fields are written (``commandId: null``, ``commandRequest: null``).
    The payload in ``value`` is the message's own text, so numbers, key order
    and repeated keys stay as they came.
    """
    resources = event_resources(F.col("resource_type"), F.col("resource_id")).alias("resources")
    head = [F.col("type").alias("type"), F.lit(commands_topic).alias("commandsTopic")]
    tail = [
        F.col("call_context").alias("callContext"),
        resources,
        F.lit(None).cast("string").alias("commandId"),
        F.lit(None).cast("struct<method:string,url:string>").alias("commandRequest"),
    ]
    text = lambda fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    inside = lambda json: json.substr(F.lit(2), F.length(json) - 2)
    value = F.concat(F.lit("{"), inside(text(head)), F.lit(',"payload":'), F.col("raw"), F.lit(","), inside(text(tail)), F.lit("}"))
    df = df.withColumn("value", value)
    if "msg" not in df.columns:
        return df
    return df.withColumn("envelope", F.struct(*head, F.col("msg").alias("payload"), *tail))


def resource_type_label(col: Column) -> Column:
    return F.coalesce(col, F.lit(NONE_RESOURCE))
