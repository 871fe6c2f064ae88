"""The tracker's CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysieve.functions.text import stripped, text


def read_applied(spark: SparkSession, path: str) -> DataFrame:
    """(company, role, link) of rows marked Applied; a byte order mark before the header is no part of it."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    names = {n.lstrip("﻿").strip().lower(): n for n in rows.columns}
    pick = lambda n: text(F.col(f"`{names[n]}`")) if n in names else F.lit("")
    return rows.where(stripped(pick("status")) == "Applied").select(pick("company").alias("company"), pick("role").alias("role"), pick("link").alias("link"))
