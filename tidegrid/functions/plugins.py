"""Parser plugins in Python: a callable from one message to its rows, as a table function."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def python_parser(parse: Callable[[dict], list[dict]], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A parser for the registry. Rows have the callable's values (null where it has none); a message for which it
    raises has a single row with the error, so that it goes to quarantine whole. The slow path: prefer columns."""
    fields = StructType.fromDDL(schema).fieldNames()

    class Rows:
        def eval(self, message: str):
            m = json.loads(message)
            m["readings"] = [json.loads(r) for r in m.get("readings") or []]
            try:
                made = [tuple(r.get(f) for f in fields) for r in parse(m)]
            except Exception as x:  # whatever a plugin raises is its message's fault
                yield (f"parser_error: {x!r}", 0, *[None] * len(fields))
                return
            for k, r in enumerate(made):
                yield (None, k, *r)

    rows = F.udtf(Rows, returnType=f"error string, at int, {schema}")
    stamped = ["message_id", "device_id", "device_class", "firmware_version", "site_id", "arrival_ts_ms"]

    def parser(messages: DataFrame) -> DataFrame:
        m = messages.select(*stamped, F.to_json(F.struct(*stamped, "readings")).alias("_message"))
        return m.lateralJoin(rows(F.col("_message").outer())).drop("_message")

    return parser
