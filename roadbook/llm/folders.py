"""Tables between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from roadbook.session import shared_folder
from roadbook.session import written_once as stored

__all__ = ["new_folder", "stored"]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
