"""Fixed schemas of every table the library reads; nothing is inferred."""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()

CATALOGUE = _schema(pos=_L, title=_S, host=_S, duration=_I)
RAW = _schema(seq=_L, raw_title=_S, raw_host=_S, raw_duration=_S)
ATTEMPT = _schema(entry_id=_L, seq=_L, raw=_S)
PROBE = _schema(probe_id=_L, term=_S)
CORRECTION = _schema(pos=_L, seq=_L, new_title=_S, new_host=_S, new_duration=_I)
COMMAND = _schema(session_id=_L, seq=_L, choice=_I, title=_S, host=_S, duration=_I)
