"""The forecast's source tables, derived from order-and-line tables.

Orders before the reporting day are encounters, later ones the schedule; lines
supply contacts, surgeries, movements and events; parts are services, providers
and procedures; suppliers are departments. Each text below is plain SQL that
both Spark and the checking engine run, so operators and check start from the
same rows. Whole tables are used throughout.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from wardcast.config import ForecastConfig, SiteCodes
from wardcast.plans.staging import Lazy
from wardcast.sources.tables import SourceTables

CONFIG = ForecastConfig(
    as_of=date(2001, 4, 1),
    hist_start=date(1995, 1, 1),
    holidays=(date(2001, 3, 19), date(2001, 4, 13), date(2001, 5, 28), date(2001, 7, 4)),
    codes=SiteCodes(
        labour_department="NATION_3",
        newborn_departments=("NATION_2", "NATION_7", "NATION_12", "NATION_22"),
        operating_locations=("AFRICA", "AMERICA", "ASIA", "EUROPE"),
    ),
)

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Identifiers made from an order and a line: office contacts are negative so that
# they never meet an order's own contact, surgery logs and cases share a number range.
_CONTACT = "-(l_orderkey * 8 + l_linenumber) - 1"
_LOG = "l_orderkey * 8 + l_linenumber"
_DESTINATION = "-(l_orderkey * 2 + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) - 1"

SOURCE_SQL: dict[str, str] = {
    "encounter": """
        SELECT o_orderkey AS csn, o_custkey AS pat_id,
               o_orderdate + CASE WHEN o_orderstatus = 'F' THEN INTERVAL '9' HOUR ELSE INTERVAL '21' HOUR END AS admit_ts,
               o_orderdate + CAST(floor(x.quantity / 8) AS INT) * INTERVAL '1' DAY + INTERVAL '15' HOUR AS disch_ts,
               o_orderdate + CASE WHEN o_orderstatus = 'F' THEN INTERVAL '13' HOUR ELSE INTERVAL '25' HOUR END AS ed_departure_ts,
               CAST(nullif(substr(o_orderpriority, 1, 1), '5') AS INT) AS acuity_c,
               1 AS pat_class_c,
               o_orderkey AS account_id,
               coalesce(x.partkey, o_custkey) AS service_c,
               coalesce(x.suppkey, 0) AS department_id,
               CASE WHEN o_totalprice < 20000 THEN 20 ELSE 10 END AS service_area,
               CASE WHEN o_totalprice > 480000 THEN 3 WHEN o_totalprice > 470000 THEN NULL ELSE 1 END AS admit_conf_c,
               CASE WHEN o_orderstatus = 'P' THEN 2
                    WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 3 END AS patient_stat_c
        FROM {orders} AS o
        LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey
                   FROM {lineitem} GROUP BY l_orderkey) AS x ON x.l_orderkey = o_orderkey
        WHERE o_orderdate < DATE '2001-04-01'
    """,
    "service_code": """
        SELECT p_partkey AS service_c, p_type || ' ' || p_brand AS service_name,
               p_type || CASE WHEN p_size <= 40 THEN ' A' ELSE ' B' END || lpad(CAST(p_size AS VARCHAR(3)), 3, '0') AS service_abbr
        FROM {part}
    """,
    "department": """
        SELECT s_suppkey AS department_id, n_name AS department_name, n_regionkey AS unit_group_c,
               CASE WHEN s_acctbal >= 0 THEN 10 ELSE 20 END AS service_area
        FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
    """,
    "unit_group": """
        SELECT r_regionkey AS unit_group_c, nullif(r_name, 'EUROPE') AS unit_group_name FROM {region}
    """,
    "patient": """
        SELECT c_custkey AS pat_id,
               CASE WHEN c_acctbal < 5000 THEN c_custkey WHEN c_acctbal < 8000 THEN c_custkey + 1 END AS mother_pat_id
        FROM {customer}
    """,
    "movement": """
        SELECT l_orderkey AS csn, o_orderdate + l_linenumber * INTERVAL '1' DAY + INTERVAL '23' HOUR AS effective_ts,
               l_suppkey AS department_id,
               CASE WHEN l_returnflag = 'N' THEN 5 ELSE 6 END AS event_type_c,
               CASE WHEN l_tax = 0 THEN 2 WHEN l_tax >= 0.08 THEN NULL ELSE 1 END AS event_subtype_c
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
    """,
    "contact": f"""
        SELECT {_CONTACT} AS csn, o_custkey AS pat_id, shipped AS contact_ts,
               CASE WHEN discount < 0.10 THEN 3 WHEN flag = 3 THEN 2 WHEN flag = 1 THEN 6 ELSE 4 END AS appt_status_c,
               suppkey AS department_id, partkey AS provider_id, shipped - INTERVAL '30' DAY AS entry_ts
        FROM (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS shipped, max(l_discount) AS discount,
                     max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS flag,
                     min(l_suppkey) AS suppkey, min(l_partkey) AS partkey
              FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) AS x
        JOIN {{orders}} ON o_orderkey = l_orderkey
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderdate, NULL, NULL, NULL,
               CASE o_orderstatus WHEN 'P' THEN o_orderdate - INTERVAL '10' DAY
                    WHEN 'F' THEN o_orderdate - INTERVAL '1' DAY ELSE o_orderdate + INTERVAL '2' DAY END
        FROM {{orders}}
    """,
    "appt_status": "SELECT r_regionkey + 2 AS appt_status_c, r_name AS appt_status FROM {region}",
    "provider": """
        SELECT p_partkey AS provider_id, p_name || CASE WHEN p_brand IN ('Brand#7', 'Brand#12', 'Brand#18') THEN ' HROB' ELSE '' END AS provider_name
        FROM {part}
    """,
    "episode_link": f"""
        SELECT DISTINCT {_CONTACT} AS csn, l_orderkey AS episode_id FROM {{lineitem}}
    """,
    "episode": "SELECT o_orderkey AS episode_id FROM {orders}",
    "due_date": """
        SELECT o_orderkey AS episode_id,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL '6' HOUR END AS due_user_ts,
               o_orderdate + INTERVAL '3' DAY AS due_system_ts,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'N' ELSE 'Y' END AS is_working
        FROM {orders}
    """,
    "delivery": """
        SELECT l_orderkey AS csn, CASE WHEN l_tax < 0.08 THEN o_orderdate + INTERVAL '26' HOUR END AS birth_ts,
               l_linenumber AS method_c
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
        WHERE l_discount >= 0.10
    """,
    "delivery_type": "SELECT r_regionkey AS method_c, r_name AS delivery_type FROM {region}",
    "surgery_log": f"""
        SELECT {_LOG} AS log_id, l_linenumber - 1 AS status_c, CAST(floor(max(l_quantity) / 10) AS INT) AS location_id,
               max(l_shipdate) + INTERVAL '8' HOUR AS surgery_ts, CASE WHEN max(l_tax) >= 0.07 THEN 1 END AS not_performed_c
        FROM {{lineitem}} WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_linenumber
    """,
    "surgery_log_detail": f"""
        SELECT {_LOG} AS log_id, min(l_partkey) AS procedure_id
        FROM {{lineitem}} WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_linenumber
    """,
    "procedure": "SELECT p_partkey AS procedure_id, p_type AS procedure_name FROM {part}",
    "location": """
        SELECT r_regionkey AS location_id, r_name AS location_name,
               CASE WHEN r_name = 'AFRICA' THEN 20 ELSE 10 END AS service_area
        FROM {region}
    """,
    "surgery_status": """
        SELECT r_regionkey AS status_c,
               CASE r_regionkey WHEN 0 THEN 'Complete' WHEN 1 THEN 'Posted' WHEN 2 THEN 'Voided'
                    WHEN 3 THEN 'Completed' ELSE 'Unposted' END AS status_name
        FROM {region}
    """,
    "admission_link": f"""
        SELECT {_LOG} AS case_id, CASE WHEN l_linestatus = 'F' THEN l_orderkey END AS admission_csn,
               CASE WHEN l_linestatus = 'F' THEN {_CONTACT} ELSE l_orderkey END AS contact_csn
        FROM {{lineitem}} WHERE l_returnflag = 'A'
        UNION ALL
        SELECT o_orderkey * 8, CASE WHEN o_orderdate < DATE '2001-04-01' THEN o_orderkey END, o_orderkey
        FROM {{orders}}
        WHERE (o_orderdate < DATE '2001-04-01' AND NOT (o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED'))
           OR (o_orderdate >= DATE '2001-04-01' AND o_orderstatus = 'P')
    """,
    "surgery_case": """
        SELECT o_orderkey * 8 AS case_id, o_custkey AS pat_id, o_orderkey AS log_id,
               CAST(floor(o_totalprice / 100000) AS INT) AS location_id, o_orderdate + INTERVAL '8' HOUR AS surgery_ts,
               CASE WHEN o_orderstatus = 'P' AND o_totalprice < 150000 THEN 2 WHEN o_orderstatus = 'F' THEN 1
                    WHEN o_orderstatus = 'O' THEN 3 ELSE 8 END AS sched_status_c,
               CASE WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 350000 THEN 9
                    WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 350000 THEN NULL ELSE 4 END AS pat_class_c
        FROM {orders}
    """,
    "case_procedure": """
        SELECT l_orderkey * 8 AS case_id, l_linenumber AS line, l_partkey AS procedure_id FROM {lineitem}
    """,
    "request": """
        SELECT o_orderkey AS comm_id, o_orderdate AS entry_ts, '10000' || CASE WHEN o_orderpriority = '1-URGENT' THEN '2' ELSE substr(o_orderpriority, 1, 1) END AS topic_c,
               CASE WHEN o_totalprice < 40000 THEN 15 ELSE 16 END AS origin_c
        FROM {orders} WHERE o_orderstatus <> 'F'
    """,
    "request_detail": """
        SELECT o_orderkey AS comm_id,
               CASE WHEN o_totalprice > 430000 THEN 6 WHEN o_totalprice > 400000 THEN 2
                    WHEN o_totalprice > 390000 THEN NULL ELSE 4 END AS status_c,
               CAST(floor(o_totalprice / 100000) AS INT) AS transfer_type_c,
               CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN NULL ELSE 1391 END AS region_id
        FROM {orders} WHERE o_orderstatus <> 'F'
        UNION ALL
        SELECT -(o_orderkey * 2) - 1, CASE WHEN o_orderpriority = '5-LOW' THEN 5 ELSE 4 END, NULL, NULL FROM {orders}
        UNION ALL
        SELECT -(o_orderkey * 2 + 1) - 1, CASE WHEN o_totalprice > 440000 THEN NULL ELSE 2 END, NULL, NULL FROM {orders}
    """,
    "attachment": """
        SELECT o_orderkey AS comm_id, 21 AS attachment_c, NULL AS csn, -(o_orderkey * 2) - 1 AS target_comm_id, 1 AS reason_c
        FROM {orders}
        UNION ALL
        SELECT o_orderkey, 21, NULL, -(o_orderkey * 2 + 1) - 1, 2 FROM {orders} WHERE o_totalprice > 100000
        UNION ALL
        SELECT -(o_orderkey * 2) - 1, 20, CASE WHEN o_totalprice > 250000 THEN o_orderkey ELSE o_orderkey + 1 END, NULL, NULL
        FROM {orders}
        UNION ALL
        SELECT -(o_orderkey * 2 + 1) - 1, 20, CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderkey - 1 ELSE o_orderkey END,
               NULL, NULL
        FROM {orders}
        UNION ALL
        SELECT -(l_orderkey * 2 + 1) - 1, 20, l_orderkey, NULL, NULL FROM {lineitem} WHERE l_linenumber = 7
        UNION ALL
        SELECT l_orderkey, 22, l_orderkey, NULL, NULL FROM {lineitem} WHERE l_linenumber = 1
    """,
    "status_history": f"""
        SELECT {_DESTINATION} AS comm_id, l_linenumber AS line,
               min(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 4 ELSE 5 END) AS status_c,
               max(l_shipdate) + INTERVAL '5' HOUR AS update_utc_ts
        FROM {{lineitem}} GROUP BY l_orderkey, l_linestatus, l_linenumber
    """,
    "request_status": "SELECT r_regionkey AS status_c, r_name AS status_name FROM {region}",
    "topic": """
        SELECT '10000' || CAST(r_regionkey AS VARCHAR(2)) AS topic_c, 'Request ' || r_name AS request_type FROM {region}
    """,
    "transfer_type": """
        SELECT r_regionkey AS transfer_type_c, nullif(r_name, 'ASIA') AS transfer_type FROM {region}
    """,
    "conf_status": "SELECT r_regionkey AS admit_conf_c, r_name AS admit_conf FROM {region}",
    "patient_status": "SELECT r_regionkey AS patient_stat_c, r_name AS patient_stat FROM {region}",
    "ed_event_link": f"SELECT DISTINCT {_LOG} AS event_id, l_orderkey AS csn FROM {{lineitem}}",
    "ed_event": f"""
        SELECT {_LOG} AS event_id,
               CASE WHEN max(l_discount) < 0.05 THEN '10410001' ELSE '10410002' END AS department_id,
               CASE WHEN max(l_tax) >= 0.07 THEN 2 WHEN max(l_tax) >= 0.04 THEN NULL ELSE 1 END AS status_c,
               CASE WHEN max(l_quantity) BETWEEN 10 AND 30 THEN '65' ELSE '55' END AS event_type
        FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber
    """,
    "acuity": "SELECT r_regionkey AS acuity_c, r_name AS acuity_name FROM {region}",
}


# The tables that nearly all of the texts group or join by order, and the order's column.
BY_ORDER = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def source_tables(spark: SparkSession, sf_dir: str, stage=Lazy()) -> SourceTables:
    """Source tables over the test tables in ``sf_dir``. There is no calendar
    table, so the days are generated from the configured dates.

    If ``stage`` stores results, orders and lines are stored in buckets by order, all rows with the columns that
    a text names, so that they are shuffled once for all texts instead of once for each.
    """
    base: dict[str, DataFrame] = {}

    def named(df: DataFrame) -> DataFrame:
        return df.select(*[c for c in df.columns if any(c in text for text in SOURCE_SQL.values())])

    def open_base(name: str) -> DataFrame:
        if name not in base:
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            stored = stage.stores and name in BY_ORDER
            base[name] = stage(f"base_{name}", named(df), by=BY_ORDER[name]) if stored else df
        return base[name]

    def open_table(name: str) -> DataFrame:
        text = SOURCE_SQL[name]
        return spark.sql(text, **{n: open_base(n) for n in BASE if "{" + n + "}" in text})

    return SourceTables(spark, open_table)
