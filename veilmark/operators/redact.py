"""Text redaction of detected values (an extension: the values of a document are replaced in its text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import mask


def redact_text(text: Column, fields: Column) -> Column:
    """Replace values by ``[REDACTED]`` or their mask, as each field's ``decision`` says."""
    return F.aggregate(fields, text, lambda acc, f: F.when(f["decision"] == "redact", F.replace(acc, f["value"], F.lit("[REDACTED]"))).when(f["decision"] == "mask", F.replace(acc, f["value"], mask(f["value"]))).otherwise(acc))
