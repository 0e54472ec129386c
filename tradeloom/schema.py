"""Fixed schemas and closed vocabularies of the records."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR_LENGTH = 384


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType())}


def _fields(text: str) -> T.StructType:
    """A schema from `name kind [not null], ...`; unlike DDL it needs no session."""
    fields = [f.split(" ", 2) for f in text.replace("`", "").split(", ")]
    return T.StructType([T.StructField(f[0], KINDS[f[1]], len(f) < 3) for f in fields])


ENTITY = _fields(
    "id string not null, type string not null, `from` string, `to` string, cc string, bcc string, ref string, digest string, status int, "
    "amount double, vector array<float>, text string not null, masked_text string, data string not null, created_at bigint not null, "
    "updated_at bigint not null, mode string, is_masked boolean"
)
TASK = _fields("id string, type string, `from` string, `to` string, cc string, bcc string, ref string, data string, created_at bigint, updated_at bigint, status int")
MESSAGE = _fields(
    "id string, type string, role string, `from` string, `to` string, cc string, bcc string, ref string, text string, data string, task_id string, status int, created_at bigint, updated_at bigint"
)

# Status words and their codes; anything else is 0.
STATUS = {
    "progress": 1,
    "stop": 2,
    "cancel": 3,
    "refund": 4,
    "return": 5,
    "error": 6,
    "expire": 7,
    "exchange": 8,
    "complete": 9,
    "draft": 10,
    "show": 11,
    "hide": 12,
}
PENDING, RUNNING, DONE, FAILED, CANCELLED = 10, 1, 9, 6, 3

# The table that holds rows of each type.
TABLE_OF_TYPE = {
    "goods": "sales",
    "order": "sales",
    "tracking": "tracking",
    "coupon": "event",
    "event": "event",
    "review": "event",
    "user": "users",
    "team": "users",
    "pages": "pages",
}
PAGE_TYPES = ("order", "goods", "tracking", "review", "coupon", "event")
TYPES_OF_MODE = {"commerce": ("goods", "order", "review", "coupon", "event"), "shipping": ("tracking",), "analytic": ("click", "hover", "change")}
