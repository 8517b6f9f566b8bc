"""Masks of column values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.errors import InvalidArgument


def quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Mask:
    """kind: null, default (value), partial (first and last characters shown, sign between), sha256, tokenize (keyed by value), custom (value is SQL)."""

    kind: str
    value: Any = None
    first: int = 0
    last: int = 0
    sign: str = "*"

    def column(self, name: str, dtype: T.DataType) -> Column:
        c = F.col(quoted(name))
        if self.kind == "null":
            return F.lit(None).cast(dtype)
        if self.kind == "default":
            return F.lit(self.value).cast(dtype)
        if self.kind == "sha256":
            return F.sha2(c.cast("string"), 256)
        if self.kind == "tokenize":
            return F.when(c.isNotNull(), F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(str(self.value or "")), F.lit("\x00"), c.cast("string")), 256), 1, 16)))
        if self.kind == "custom":
            return F.expr(self.value)
        if self.kind == "partial":
            if not isinstance(dtype, T.StringType):
                return F.lit(None).cast(dtype)
            hidden = F.length(c) - (self.first + self.last)
            shown = F.concat(F.substr(c, F.lit(1), F.lit(self.first)), F.repeat(F.lit(self.sign), hidden), F.substr(c, F.length(c) - self.last + 1, F.lit(self.last)))
            return F.when(hidden <= 0, F.repeat(F.lit(self.sign), F.length(c))).otherwise(shown)
        raise InvalidArgument(f"unknown mask '{self.kind}'")
