"""Source-corpus tables made of the driver's tables: the same SQL text runs in Spark and, for the oracle, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations"]

_HALF = "CAST(floor(k / 2.0) AS BIGINT)"
#: One Python file for each part: imports of the file with half the number and of the first one, and one function.
FILES = f"""
SELECT 'corpus' AS repo, 'r1' AS revision, k, concat('src/m', CAST(k % 20 AS STRING), '/f', CAST(k AS STRING), '.py') AS path, p_size,
  concat(
    CASE WHEN k > 0 THEN concat('from src.m', CAST({_HALF} % 20 AS STRING), '.f', CAST({_HALF} AS STRING), ' import run_', CAST({_HALF} AS STRING), chr(10)) ELSE '' END,
    CASE WHEN p_size < 15 THEN concat('from src.m0.f0 import run_0', chr(10)) ELSE '' END,
    CASE WHEN k % 5 = 0 THEN concat('import json', chr(10)) ELSE '' END,
    CASE WHEN k % 11 = 0 THEN concat('from .missing import gone', chr(10)) ELSE '' END,
    'def run_', CAST(k AS STRING), '(order):', chr(10), '    return run_', CAST({_HALF} AS STRING), '(order)', chr(10)) AS content
FROM (SELECT p_partkey AS k, p_size FROM {{part}})
"""
#: Documents as files of a source tree.
TREE = """
SELECT source AS repo, 'r1' AS revision, doc_id, concat(lang, '/', CAST(doc_id AS STRING), CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.rs' WHEN 'de' THEN '.ts' ELSE '.md' END) AS path, text AS content
FROM {documents}
"""
#: The same in two revisions, each with a half of the files.
TREE2 = TREE.replace("'r1' AS revision", "CASE WHEN doc_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS revision")
#: Edges from parts to suppliers.
EDGES = """
SELECT 'corpus' AS repo, 'r1' AS revision, concat('P', CAST(l_partkey AS STRING)) AS from_id, concat('S', CAST(l_suppkey AS STRING)) AS to_id, l_returnflag AS kind, CAST(l_linenumber AS INT) AS line, l_orderkey, l_quantity, l_shipdate
FROM {lineitem}
"""
#: Imports of FILES as edges: each file to the one with half its number.
CHAIN = f"SELECT 'corpus' AS repo, 'r1' AS revision, concat('e', CAST(k AS STRING)) AS edge_id, k AS a, {_HALF} AS b, concat('f', CAST(k AS STRING)) AS from_id, concat('f', CAST({_HALF} AS STRING)) AS to_id FROM (SELECT p_partkey AS k FROM {{part}}) WHERE k > 0"
#: Trace events: one session for each user, in order of time.
TRACE = """
SELECT CAST(user_id AS STRING) AS session_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence,
  CASE event_type WHEN 'view' THEN 'enter' WHEN 'click' THEN 'enter' WHEN 'purchase' THEN 'exit' WHEN 'signup' THEN 'exit' ELSE 'error' END AS phase,
  concat('s', CAST(event_id % 5 AS STRING)) AS symbol_id, concat('s', CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 5 AS STRING)) AS parent_raw,
  lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_id, CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_type
FROM {events}
"""
#: Run events: one run for each conversation.
RUNS = """
SELECT CAST(conv_id AS STRING) AS run_id, concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS event_id, turn + 1 AS sequence, role AS type, text AS payload FROM {conversations}
"""
#: Evaluation: the case is the language, oracle and prediction are edges from case to document.
EVAL = """
SELECT d.lang AS case_id, concat('c', CAST(d.doc_id % 7 AS STRING)) AS from_name, concat('d', CAST(d.doc_id AS STRING)) AS to_name, l.quality AS quality, CAST(d.n_chars > 1500 AS INT) AS predicted, d.source AS provider_id, l.toxic AS toxic
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""
#: Two revisions of the customers as claims.
CLAIMS = """
SELECT 'corpus' AS repo, 'r1' AS revision, concat('component:', CAST(c_custkey AS STRING)) AS subject_id, 'responsibility' AS key, c_mktsegment AS inferred_value,
  CASE c_custkey % 3 WHEN 0 THEN concat(' ', c_mktsegment) WHEN 1 THEN 'OTHER' END AS authored_value, c_custkey, c_acctbal
FROM {customer}
"""
#: Symbols: one for each order line's part and supplier, with spans that nest.
SYMBOLS = """
SELECT 'corpus' AS repo, 'r1' AS revision, concat('src/m', CAST(k % 20 AS STRING), '/f', CAST(k AS STRING), '.py') AS path, concat('run_', CAST(k AS STRING)) AS name, 'function' AS kind,
  concat('src/m', CAST(k % 20 AS STRING), '/f', CAST(k AS STRING), '.py#run_', CAST(k AS STRING), ':', CAST(k % 9 + 1 AS STRING)) AS symbol_id,
  CAST(k % 9 + 1 AS INT) AS line, CAST(k % 9 + 1 + p_size AS INT) AS end_line, p_size % 2 = 0 AS exported, k
FROM (SELECT p_partkey AS k, p_size FROM {part})
"""


class Data:
    """The driver's tables and the bindings over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


def oracle(text: str) -> str:
    """The same text for DuckDB: table names in place of their marks."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
