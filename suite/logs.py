"""Log templates over lines made from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import register
from weftline.operators import logs
from weftline.session import load

# three shapes: one merges on its many users, one on masks alone, one stays as it is
_LINE = """CASE WHEN event_type IN ('click', 'view')
                THEN 'session opened for user u' || cast(user_id AS {text}) || ' from 10.0.' || cast(user_id % 250 AS {text}) || '.7 port ' || cast(event_id AS {text})
                WHEN event_type = 'error' THEN 'disk /dev/sd' || cast(user_id % 3 AS {text}) || ' error code 0x' || cast(event_id AS {text})
                ELSE 'heartbeat ok' END"""

_TEMPLATES = """SELECT pattern, count(*) AS count FROM (
    SELECT CASE WHEN event_type IN ('click', 'view') THEN 'session opened for user <*> from <ip> port <num>'
                WHEN event_type = 'error' THEN 'disk <path> error code <hex>' ELSE 'heartbeat ok' END AS pattern FROM events) l GROUP BY pattern"""


def _lines(spark, folder):
    load(spark, folder, "events").createOrReplaceTempView("events")
    return spark.sql(f"SELECT event_id, {_LINE.format(text='STRING')} AS line FROM events")


@register(
    "log01_templates",
    f"""WITH t AS ({_TEMPLATES}), l AS (SELECT {_LINE.format(text='VARCHAR')} AS line,
                  CASE WHEN event_type IN ('click', 'view') THEN 'session opened for user <*> from <ip> port <num>'
                       WHEN event_type = 'error' THEN 'disk <path> error code <hex>' ELSE 'heartbeat ok' END AS pattern FROM events)
        SELECT row_number() OVER (ORDER BY count DESC, t.pattern) AS template_id, t.pattern, count,
               (SELECT min(line) FROM l WHERE l.pattern = t.pattern) AS example FROM t""",
)
def log01(spark, folder):
    return logs.log_templates(_lines(spark, folder), "line")


@register(
    "log02_records",
    f"""WITH t AS ({_TEMPLATES}), i AS (SELECT pattern, row_number() OVER (ORDER BY count DESC, pattern) AS template_id FROM t)
        SELECT event_id, template_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'u' || user_id || '|10.0.' || (user_id % 250) || '.7|' || event_id
                    WHEN event_type = 'error' THEN '/dev/sd' || (user_id % 3) || '|0x' || event_id ELSE '' END AS captured
        FROM events e JOIN i ON i.pattern = CASE WHEN event_type IN ('click', 'view') THEN 'session opened for user <*> from <ip> port <num>'
                       WHEN event_type = 'error' THEN 'disk <path> error code <hex>' ELSE 'heartbeat ok' END""",
)
def log02(spark, folder):
    out = logs.log_records(_lines(spark, folder), "line")
    return out.select("event_id", "template_id", F.array_join("values", "|").alias("captured"))


@register("log01_document_templates")
def log01_documents(spark, folder):
    # every line of every document: free text with junk, secrets and license lines
    lines = load(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return logs.log_templates(lines.where("trim(line) <> ''"), "line")
