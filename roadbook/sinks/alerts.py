"""Alert rows on their way out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: message key of an alert that concerns no vehicle.
PIPELINE_KEY = "pipeline"


def with_defaults(alerts: DataFrame) -> DataFrame:
    """Severity WARNING and the current time where an alert leaves them out."""
    return alerts.withColumns(
        {
            "severity": F.coalesce("severity", F.lit("WARNING")),
            "created_at": F.coalesce("created_at", F.current_timestamp()),
        }
    )


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Key and JSON text per alert, keyed so that one vehicle's alerts stay in order."""
    iso = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    wire = alerts.withColumns({"idle_minutes": F.col("idle_minutes").cast("double"), "created_at": iso})
    return wire.select(
        F.coalesce("vehicle_id", F.lit(PIPELINE_KEY)).alias("key"),
        F.to_json(F.struct("*")).alias("value"),
    )


def publish_alerts(alerts: DataFrame, sink_format: str = "kafka", **options: str) -> None:
    """Write the messages to a topic (``topic`` and ``kafka.bootstrap.servers`` among the options)."""
    alert_messages(alerts).write.format(sink_format).mode("append").options(**options).save()
