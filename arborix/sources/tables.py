"""The given tables, and the shapes of the engine that are read out of them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.plans.catalogue import METRICS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Unset, a local master gets a temporary one; on a cluster that is an error,
    as executors would write to disks that nobody else sees."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-arborix-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def use_shared_folder(spark: SparkSession) -> None:
    """Lets checkpoints of this session go to :func:`shared_folder`."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into :func:`shared_folder` and read back, which ends its lineage: lost executors cost no recomputation of what led to it."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ITEMS = ["Share Premium Account", "Retained Earnings", "Revaluation Reserves", "Other Reserves", "Capital Redemption Reserve", "Treasury Stock"]
_DEBTS = {"Overdrafts": "1-URGENT", "Trade Finance": "2-HIGH", "Loans < 1 year - Secured": "3-MEDIUM", "Loans < 1 year - Unsecured": "4-NOT SPECIFIED", "Current Portion - HP/Leasing/Other": "5-LOW"}
#: What each looked-up figure is, as SQL over a joined order line; p is its price, d and x price times discount and tax.
FACTS: dict[str, str] = {
    "Revenue": "p",
    "Cost of Sales": "case when l_returnflag = 'R' then p end",
    "Depreciation": "d",
    "Amortization": "x",
    "Profit before Taxes": "case when l_returnflag = 'N' then p - d end",
    "Interest Paid": "case when l_linestatus = 'O' then x end",
    "Interest Received": "case when l_linestatus = 'F' then x end",
    "other Operating income": "case when l_returnflag = 'A' then q end",
    "all Operating costs": "case when l_returnflag = 'N' then q end",
    "Receivables": "case when o_orderstatus = 'F' then p end",
    "Inventory": "case when o_orderstatus = 'O' then p end",
    "Payables": "case when o_orderstatus = 'P' then p end",
    "Operating cashflow": "p - d",
    "Capital Expenditure": "-d",
    "w/w Dividends": "-x",
    "Ordinary Shares": "case when l_linenumber = 1 then p end",
    "Preference Shares": "case when l_linenumber = 2 then p end",
    "Net Intangible Assets": "case when n_nationkey % 5 <> 0 and l_linenumber = 7 then p end",
    "Cash": "case when n_nationkey % 7 = 0 then p - p else d end",
    "Marketable Investments": "case when n_nationkey % 7 = 0 then p - p else x end",
} | {n: f"case when l_linenumber = {i + 1} then p end" for i, n in enumerate(_ITEMS)} | {n: f"case when o_orderpriority = '{v}' then p end" for n, v in _DEBTS.items()}

_LINES = """
SELECT n_name AS company, cast(year(o_orderdate) AS string) AS year_period, n_nationkey, o_orderstatus, o_orderpriority, l_returnflag, l_linestatus, l_linenumber,
       cast(l_extendedprice AS decimal(18, 4)) AS p, cast(l_extendedprice * l_discount AS decimal(18, 4)) AS d,
       cast(l_extendedprice * l_tax AS decimal(18, 4)) AS x, cast(l_quantity AS decimal(18, 4)) AS q
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""


_SPLIT = "company, year_period, n_nationkey, o_orderstatus, o_orderpriority, l_returnflag, l_linestatus, l_linenumber"


def facts_sql(**names: str) -> str:
    """One row a company and year with a column f<i> for each metric of the catalogue; money is summed as decimals.

    Order lines are first summed by the attributes that figures tell apart: four sums a line before the shuffle instead of
    one for each figure, and at most some hundred rows a company and year after it.
    """
    tables = {t: names.get(t, t) for t in ("lineitem", "orders", "customer", "nation")}
    columns = ", ".join(f"cast({f'sum({FACTS[n]})' if n in FACTS else 'null'} AS double) AS f{i}" for i, n in enumerate(METRICS))
    summed = f"SELECT {_SPLIT}, sum(p) AS p, sum(d) AS d, sum(x) AS x, sum(q) AS q FROM ({_LINES.format(**tables)}) lines GROUP BY {_SPLIT}"
    return f"SELECT company, year_period, {columns} FROM ({summed}) summed GROUP BY company, year_period"


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(facts_sql(**{t: "{" + t + "}" for t in ("lineitem", "orders", "customer", "nation")}), **{t: table(spark, folder, t) for t in ("lineitem", "orders", "customer", "nation")})


def conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page list for each conversation: doc_pk, page_no (from 1), text, token_count."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_pk"), (F.col("turn") + 1).alias("page_no"), "role", text.alias("text"), F.size(F.regexp_extract_all(text, F.lit(r"[^ ]+"), F.lit(0))).cast("long").alias("token_count")
    )
