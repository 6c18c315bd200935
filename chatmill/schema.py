"""Explicit schemas for the record kinds the engine reads. JSON is never schema-inferred."""

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
INTS = T.ArrayType(T.IntegerType())
STRINGS = T.ArrayType(T.StringType())
RUBRIC = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


CONVERSATION = _struct(("id", T.StringType()), ("source", T.StringType()), ("messages", MESSAGES))
PREFERENCE = _struct(("chosen", MESSAGES), ("rejected", MESSAGES))
VERIFIABLE = _struct(("messages", MESSAGES), ("ground_truth", STRINGS), ("dataset", STRINGS))
TOKENISED = _struct(("input_ids", INTS), ("attention_mask", INTS), ("labels", INTS))
COMPLETION = _struct(
    ("prompt_id", T.StringType()),
    ("sample_idx", T.IntegerType()),
    ("messages", MESSAGES),
    ("model_completion", T.StringType()),
    ("reference_completion", T.StringType()),
)
TOOL_CALL = _struct(("tool_name", T.StringType()), ("success", T.BooleanType()), ("runtime", T.DoubleType()))
ROLLOUT = _struct(
    ("step", T.LongType()),
    ("sample_idx", T.IntegerType()),
    ("prompt_idx", T.LongType()),
    ("prompt_tokens", INTS),
    ("response_tokens", INTS),
    ("reward", T.DoubleType()),
    ("advantage", T.DoubleType()),
    ("finish_reason", T.StringType()),
    ("dataset", T.StringType()),
    ("tool_calls", T.ArrayType(TOOL_CALL)),
)
ANNOTATION = _struct(
    ("instance_index", T.IntegerType()),
    ("instance_id", T.StringType()),
    ("model_a", T.StringType()),
    ("model_b", T.StringType()),
    ("completion_a_is_acceptable", T.StringType()),
    ("completion_b_is_acceptable", T.StringType()),
    ("preference", T.StringType()),
    ("evaluator", T.StringType()),
    ("timestamp", T.StringType()),
)
TREE_NODE = _struct(
    ("message_id", T.StringType()),
    ("parent_id", T.StringType()),
    ("role", T.StringType()),
    ("text", T.StringType()),
    ("deleted", T.BooleanType()),
    ("labels", _struct(("name", STRINGS), ("value", T.ArrayType(T.DoubleType())))),
)
USAGE = _struct(("prompt_tokens", T.LongType()), ("completion_tokens", T.LongType()))
CHOICE = _struct(("finish_reason", T.StringType()), ("message", MESSAGE))
BATCH_RESULT = _struct(
    ("custom_id", T.StringType()),
    ("response", _struct(("body", _struct(("choices", T.ArrayType(CHOICE)), ("usage", USAGE))))),
)
MODEL_OUTPUT = _struct(
    ("id", T.StringType()), ("text", T.StringType()), ("outputs", T.ArrayType(_struct(("text", T.StringType()))))
)


def is_message_list(dtype: T.DataType) -> bool:
    """True for an array of structs that has string ``role`` and ``content`` fields."""
    if not isinstance(dtype, T.ArrayType) or not isinstance(dtype.elementType, T.StructType):
        return False
    fields = {f.name: f.dataType for f in dtype.elementType.fields}
    return all(isinstance(fields.get(k), T.StringType) for k in ("role", "content"))


def require_messages(df, column: str = "messages") -> None:
    if column not in df.columns or not is_message_list(df.schema[column].dataType):
        raise ValueError(f"column {column!r} must be an array of (role, content) structs")
