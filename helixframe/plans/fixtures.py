"""Genomic projections of the driver's tables, for Spark (functions) and for DuckDB (SQL).

They are projections only: every row of the table becomes a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# In both dialects; IDIV(a, b) is integer division.
_SQL = {
    "iv": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       'chr' || CAST(l_suppkey % 5 + 1 AS STRING) AS chrom,
       CAST(l_partkey * 50 + l_linenumber * 7 AS BIGINT) AS `start`,
       CAST(l_partkey * 50 + l_linenumber * 7 + CAST(l_quantity AS BIGINT) AS BIGINT) AS `end`,
       l_returnflag AS name, l_extendedprice AS score, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand
FROM lineitem""",
    "rg": """
SELECT p_partkey AS region_id, 'chr' || CAST(p_partkey % 5 + 1 AS STRING) AS chrom, CAST(p_partkey * 50 AS BIGINT) AS `start`,
       CAST(p_partkey * 50 + p_size * 10 AS BIGINT) AS `end`, p_brand AS name, p_retailprice AS score,
       CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand
FROM part""",
    "vr": """
SELECT o_orderkey AS var_id, 'chr' || CAST(o_custkey % 5 + 1 AS STRING) AS chrom, CAST(1 + (o_orderkey % 5000) * 10 AS BIGINT) AS pos,
       substr('ACGT', CAST(1 + o_orderkey % 4 AS INT), 1) AS ref,
       CASE WHEN o_orderkey % 7 = 0 THEN substr('ACGT', CAST(1 + IDIV(o_orderkey, 4) % 4 AS INT), 1) || 'GT'
            ELSE substr('ACGT', CAST(1 + IDIV(o_orderkey, 4) % 4 AS INT), 1) END AS alt,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 1000 END AS qual,
       CASE WHEN o_orderkey % 5 = 0 THEN 'q10' WHEN o_orderkey % 9 = 0 THEN 's50' ELSE NULL END AS filter,
       o_orderstatus AS status, o_orderkey % 3 AS flag, CAST(floor(o_totalprice) AS BIGINT) % 100 AS dp,
       CASE o_orderkey % 4 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1|1' ELSE './.' END AS gt_a,
       CASE o_custkey % 3 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' ELSE '0|0' END AS gt_b,
       CAST(floor(o_totalprice) AS BIGINT) % 41 AS sac0, CAST(floor(o_totalprice) AS BIGINT) % 37 AS sac1, CAST(floor(o_totalprice) AS BIGINT) % 31 AS sac2, CAST(floor(o_totalprice) AS BIGINT) % 29 AS sac3
FROM orders""",
    "al": """
SELECT event_id, 'r' || CAST(IDIV(event_id, 2) AS STRING) AS name,
       CAST(1 + CASE WHEN event_id % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN event_id % 3 = 0 THEN 16 ELSE 0 END
            + CASE WHEN event_id % 17 = 0 THEN 4 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 1024 ELSE 0 END
            + CASE WHEN event_id % 13 = 0 THEN 256 ELSE 0 END + CASE WHEN event_id % 5 <> 0 THEN 2 ELSE 0 END AS INT) AS flag,
       'chr' || CAST(user_id % 5 + 1 AS STRING) AS chrom, CAST((event_id * 37) % 20000 AS BIGINT) AS pos, CAST(event_id % 61 AS INT) AS mapq,
       CASE event_id % 6 WHEN 0 THEN '50M' WHEN 1 THEN '10S40M' WHEN 2 THEN '20M5I25M' WHEN 3 THEN '20M10D30M' WHEN 4 THEN '25M100N25M' ELSE '40M10S' END AS cigar,
       CAST((event_id * 13) % 700 - 350 AS INT) AS tlen, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 3 AS INT) END AS nh,
       CAST(event_id % 7 AS INT) AS nm, CAST(event_id % 50 AS INT) AS score_as, 'rg' || CAST(event_id % 3 AS STRING) AS read_group,
       translate(md5(CAST(event_id AS STRING)) || substr(md5(CAST(event_id + 1 AS STRING)), 1, 18), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq,
       translate(md5(CAST(event_id + 7 AS STRING)) || substr(md5(CAST(event_id + 8 AS STRING)), 1, 18), '0123456789abcdef', '#%(+-/1357:<>@BI') AS qual
FROM events""",
    "fq": """
SELECT event_id, 'r' || CAST(IDIV(event_id, 2) AS STRING) AS name, CAST(event_id % 2 + 1 AS INT) AS mate,
       'FC1:' || CAST(user_id % 4 + 1 AS STRING) || ':' || substr(translate(md5(CAST(IDIV(event_id, 2) % 8 AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 6) AS comment,
       CASE WHEN event_id % 6 = 0 THEN 'NN' ELSE '' END
         || translate(substr(md5(CAST(event_id AS STRING)), 1, CAST(20 + event_id % 13 AS INT)), '0123456789abcdef', 'ACGTACGTACGTNACG')
         || CASE WHEN event_id % 4 = 0 THEN 'AGATCGGAAGAGCAC' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN 'N.' ELSE '' END AS seq,
       substr(translate(md5(CAST(event_id + 3 AS STRING)) || md5(CAST(event_id + 4 AS STRING)), '0123456789abcdef', '#%(+-/1357:<>@BI'), 1,
              CAST(length(CASE WHEN event_id % 6 = 0 THEN 'NN' ELSE '' END) + 20 + event_id % 13 + CASE WHEN event_id % 4 = 0 THEN 15 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS INT)) AS qual
FROM events""",
    "fa": """
SELECT 'ctg' || CAST(doc_id AS STRING) AS name,
       translate(upper(REGEX(coalesce(text, ''), '[^A-Za-z]', '')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'CANTACGTACGTACGTACGTAC') AS seq
FROM documents""",
    "gx": """
SELECT 'g' || CAST(p_partkey AS STRING) AS gene_id, 'G' || CAST(p_partkey AS STRING) AS gene_name,
       CASE WHEN p_size % 3 = 0 THEN 'lincRNA' ELSE 'protein_coding' END AS biotype, 'chr' || CAST(p_partkey % 5 + 1 AS STRING) AS chrom,
       CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, t.t AS transcript, k.k AS exon,
       CAST(p_partkey * 300 + k.k * 400 + t.t * 10 AS BIGINT) AS `start`, CAST(p_partkey * 300 + k.k * 400 + 100 + p_size + t.t * 10 AS BIGINT) AS `end`
FROM part CROSS JOIN (VALUES (1), (2)) AS t(t) CROSS JOIN (VALUES (0), (1), (2)) AS k(k)""",
}
_TABLES = {"iv": "lineitem", "rg": "part", "vr": "orders", "al": "events", "fq": "events", "fa": "documents", "gx": "part"}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame."""
    import re

    table = _TABLES[name]
    sql = re.sub(r"IDIV\((\w+|\w+ \+ \d+), (\d+)\)", r"(\1 div \2)", _SQL[name]).replace("REGEX(", "regexp_replace(")
    sql = re.sub(rf"\bFROM {table}\b", "FROM {t}", sql)
    return spark.sql(sql, t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def duck(name: str) -> str:
    """A projection as DuckDB SQL."""
    import re

    sql = re.sub(r"IDIV\((\w+|\w+ \+ \d+), (\d+)\)", r"(\1 // \2)", _SQL[name]).replace("`", '"').replace("AS STRING", "AS VARCHAR")
    return re.sub(r"REGEX\((.*?, '\[.*?\]', '')\)", r"regexp_replace(\1, 'g')", sql)


def with_sql(names: str, body: str) -> str:
    """DuckDB SQL: the projections ``names`` (by space) as CTEs ahead of ``body``, which may begin with further CTEs after WITH."""
    ctes = ",\n".join(f"{n} AS ({duck(n)})" for n in names.split())
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
