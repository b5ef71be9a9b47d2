"""Access-log view over the events table: one log line per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import spread

_LINE = """
case
 when event_id % 100 = 13 then ''
 when event_id % 100 = 11 then concat('invalid log line ', cast(event_id as string))
 when event_id % 100 = 17 then concat(
   concat('10.0.', cast(user_id div 256 as string), '.', cast(user_id % 256 as string)),
   ' WARN "PUT /job/', cast(event_id % 9 as string), ' HTTP/1.1" 503 upstream')
 else concat(
   concat('10.0.', cast(user_id div 256 as string), '.', cast(user_id % 256 as string)),
   ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'),
   case when event_id % 40 = 9 then ' -0500' else ' +0000' end, '] "',
   case event_type when 'purchase' then 'POST' when 'error' then 'DELETE' when 'signup' then 'PUT' else 'GET' end,
   ' /', event_type, '/', cast(event_id % 37 as string),
   case when event_id % 50 = 0 then '/../../etc/passwd' when event_id % 50 = 21 then '?q=1+UNION+SELECT' else '' end,
   ' HTTP/1.1" ',
   case when event_type = 'error' then '500' when event_id % 11 = 0 then '404' else '200' end, ' ',
   case when event_id % 50 = 7 then '-' else cast(cast(floor(value * 100) as bigint) as string) end,
   case when event_id % 20 = 3 then '' else concat(' "-" "agent/', cast(user_id % 7 as string), '"') end)
end
"""


def access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, ingest_ts, line) from ``events.parquet``."""
    return from_events(spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id"))


def from_events(events: DataFrame) -> DataFrame:
    # generated, so that the text is built once per row however often later steps refer to it
    line = F.inline(F.array(F.struct(F.expr(_LINE).alias("line"))))
    return events.select(F.col("event_id").alias("line_no"), F.col("ts").alias("ingest_ts"), line)
