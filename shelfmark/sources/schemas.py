"""Explicit schemas of everything that is read or written."""

from pyspark.sql import types as T

from shelfmark import constants as K

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


RAW_CATALOG = _struct(*[(name, _S) for name in K.RAW_COLUMNS])

PROCESSED_CATALOG = _struct(
    ("title", _S), ("partner", _S), ("rating", _D), ("reviews", _S), ("metadata", _S),
    ("link", _S), ("category", _S), ("scraped_at", _S), ("source_domain", _S),
    ("num_ratings", _L), ("duration_hours", _D), ("level_enc", T.IntegerType()),
    ("title_clean", _S), ("popularity_score", _D), ("id", _L), ("price", _S),
)

CARD_RECORD = _struct(
    ("platform", _S), ("scraped_at", _S), ("title", _S), ("url", _S), ("instructor", _S),
    ("rating", _D), ("reviews", _L), ("duration_hours", _D), ("lectures", _L), ("level", _S),
    ("current_price", _S), ("original_price", _S), ("students", _L), ("last_updated", _S),
)

INTERACTIONS = {
    "users": _struct(("id", _L), ("username", _S), ("email", _S), ("password", _S),
                     ("created_at", _S), ("last_login", _S)),
    "searches": _struct(("id", _L), ("user_id", _L), ("query", _S), ("timestamp", _S)),
    "clicks": _struct(("id", _L), ("user_id", _L), ("course_id", _L), ("course_title", _S),
                      ("category", _S), ("level", _S), ("platform", _S), ("timestamp", _S)),
    "favorites": _struct(("id", _L), ("user_id", _L), ("course_id", _L), ("timestamp", _S)),
    "saved_paths": _struct(("id", _L), ("user_id", _L), ("category", _S), ("path_data", _S),
                           ("timestamp", _S)),
}

PATH_STEP = _struct(("step", T.IntegerType()), ("level", _S), ("course_id", _L), ("title", _S),
                    ("rating", _D), ("duration", _D), ("category", _S))
PATH_DATA = T.ArrayType(PATH_STEP)

_COUNTS = T.MapType(_S, _L)
BEHAVIOUR = T.MapType(_S, _struct(
    ("searches", T.ArrayType(_struct(("query", _S), ("timestamp", _S)))),
    ("clicks", T.ArrayType(_struct(("course_id", _L), ("title", _S), ("category", _S),
                                   ("level", _S), ("platform", _S), ("timestamp", _S)))),
    ("views", T.ArrayType(_struct(("course_id", _L), ("timestamp", _S)))),
    ("favorites", T.ArrayType(_L)),
    ("preferences", _struct(("categories", _COUNTS), ("levels", _COUNTS),
                            ("platforms", _COUNTS))),
))
USER_RECORDS = T.MapType(_S, _struct(("email", _S), ("created_at", _S), ("last_login", _S)))

EVENT = _struct(("event_id", _L), ("ts", T.TimestampType()), ("user_id", _L), ("kind", _S),
                ("course_id", _L), ("query", _S), ("action", _S))
