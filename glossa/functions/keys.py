"""Request identity for the response cache."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"
NULL_MARK = "\u0000"


def request_key(model: Column, content: Column, temperature: float, include_reasoning: bool) -> Column:
    """SHA-256 hex of (model, content, temperature, reasoning flag).

    ``concat_ws`` drops nulls, which would let (null, 'ab') and ('ab', null)
    collide, so each part is coalesced to a marker first. The temperature is
    formatted on the driver (Python ``repr``) so every engine sees the same text.
    """
    parts = [F.coalesce(model.cast("string"), F.lit(NULL_MARK)),
             F.coalesce(content.cast("string"), F.lit(NULL_MARK)),
             F.lit(repr(float(temperature))),
             F.lit("true" if include_reasoning else "false")]
    return F.sha2(F.concat_ws(SEP, *parts), 256)
