"""Declared schemas of the raw tables."""

from __future__ import annotations

from pyspark.sql import types as T

from duelytics.constants import FEEDBACK_FLAGS

STRING, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(STRING)
TRANSCRIPT = T.ArrayType(T.StructType().add("role", STRING).add("content", STRING))


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


VOTES = struct(
    model_a_name=STRING,
    model_b_name=STRING,
    conv_turns=LONG,
    timestamp=T.TimestampNTZType(),
    chosen_model_name=STRING,
    both_equal=BOOL,
    conversation_a=TRANSCRIPT,
    conversation_b=TRANSCRIPT,
    opening_msg=STRING,
    selected_category=STRING,
    conv_comments_a=STRING,
    conv_comments_b=STRING,
    **{f"conv_{flag}_{side}": BOOL for flag in FEEDBACK_FLAGS for side in ("a", "b")},
)

PRICE_LIST = struct(
    offset=LONG,
    data=T.ArrayType(struct(id=STRING, pricing=struct(completion=STRING))),
)

BIAS_SCORES = struct(
    model=STRING,
    joconde_score=DOUBLE,
    joconde_couverture=DOUBLE,
    joconde_periodes=STRING,
    joconde_domaines=STRING,
    basilic_score=DOUBLE,
    basilic_couverture=DOUBLE,
    basilic_regions=STRING,
    basilic_types=STRING,
    tfidf_discriminants=STRING,
    tfidf_communs=STRING,
)
