"""Sequencing-shaped views over the driver's tables: one text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Length of each contig of `aln`: every block ends below it.
CONTIG_LENGTH = 5_200

ALN = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, concat('r', CAST(l_orderkey AS STRING)) AS qname,
 CASE WHEN l_suppkey % 25 = 0 THEN 'chrM' ELSE concat('chr', CAST(l_suppkey % 22 + 1 AS STRING)) END AS contig,
 CAST((l_partkey * 37 + l_linenumber * 11) % 5000 AS BIGINT) AS pos0,
 CAST(floor(l_quantity) AS INT) + 25 AS mlen,
 CAST((l_orderkey * 7 + l_linenumber) % 61 AS INT) AS mapq,
 CAST(1 + CASE WHEN l_linenumber % 3 <> 0 THEN 2 ELSE 0 END
   + CASE WHEN (l_orderkey + l_linenumber) % 29 = 0 THEN 4 ELSE 0 END
   + CASE WHEN (l_orderkey + l_linenumber) % 43 = 0 THEN 8 ELSE 0 END
   + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END
   + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END
   + CASE WHEN (l_orderkey * 3 + l_linenumber) % 31 = 0 THEN 256 ELSE 0 END
   + CASE WHEN (l_orderkey * 5 + l_linenumber) % 37 = 0 THEN 512 ELSE 0 END
   + CASE WHEN (l_orderkey + l_linenumber * 5) % 23 = 0 THEN 1024 ELSE 0 END
   + CASE WHEN (l_orderkey * 11 + l_linenumber) % 41 = 0 THEN 2048 ELSE 0 END AS INT) AS flag,
 CAST((l_partkey * 13 + l_suppkey) % 1200 AS INT) - 100 AS tlen
FROM {lineitem}
"""

ALNC = f"""
SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN concat(CAST(mlen AS STRING), 'M')
 WHEN l_linenumber % 4 = 1 THEN concat('5S', CAST(mlen AS STRING), 'M')
 WHEN l_linenumber % 4 = 2 THEN concat('10M100N', CAST(mlen - 10 AS STRING), 'M')
 ELSE concat('10M2I5M3D', CAST(mlen - 15 AS STRING), 'M') END AS cigar,
 CAST((l_orderkey * 3 + l_linenumber) % 50 AS DOUBLE) / 1000 AS de
FROM ({ALN}) a
"""

#: Blocks of ALNC by plain arithmetic; what the CIGAR walk must give.
BLOCKS = f"""
SELECT *, pos0 AS start, pos0 + mlen AS "end" FROM ({ALNC}) b WHERE l_linenumber % 4 IN (0, 1)
UNION ALL SELECT *, pos0, pos0 + 10 FROM ({ALNC}) b WHERE l_linenumber % 4 IN (2, 3)
UNION ALL SELECT *, pos0 + 110, pos0 + 100 + mlen FROM ({ALNC}) b WHERE l_linenumber % 4 = 2
UNION ALL SELECT *, pos0 + 10, pos0 + 15 FROM ({ALNC}) b WHERE l_linenumber % 4 = 3
UNION ALL SELECT *, pos0 + 18, pos0 + 3 + mlen FROM ({ALNC}) b WHERE l_linenumber % 4 = 3
"""

#: Reads: whole texts, a null one as empty.
FQ = """
SELECT doc_id AS read_id, translate(coalesce(text, ''),
  'BDEFHIJKLMOPQRSUVWXYZbdefhijklmopqrsuvwxyzacgtn .,',
  'ACGTACGTACGTACGTACGTAACGTACGTACGTACGTACGTAACGTNNNN') AS seq
FROM {documents}
"""

TX = """
SELECT CAST(p_partkey AS BIGINT) AS tx_id, concat('G', CAST(p_partkey % 200 AS STRING)) AS gene_id,
 concat('chr', CAST(p_partkey % 200 % 22 + 1 AS STRING)) AS chrom,
 CASE WHEN p_partkey % 200 % 2 = 0 THEN '+' ELSE '-' END AS strand,
 CAST((p_partkey * 101) % 4000 AS BIGINT) AS e1s, CAST((p_partkey * 101) % 4000 + 50 + p_size AS BIGINT) AS e1e,
 CAST((p_partkey * 101) % 4000 + 300 AS BIGINT) AS e2s, CAST((p_partkey * 101) % 4000 + 400 + p_size AS BIGINT) AS e2e
FROM {part}
"""

#: Contaminant intervals, which overlap each other.
CONTAM = """
SELECT concat('chr', CAST(s_suppkey % 22 + 1 AS STRING)) AS chrom, CAST((s_suppkey * 53) % 4800 AS BIGINT) AS start,
 CAST((s_suppkey * 53) % 4800 + 40 + s_suppkey % 60 AS BIGINT) AS "end"
FROM {supplier}
"""

#: Targets with names; one without.
TARGETS = """
SELECT concat('chr', CAST(n_nationkey % 22 + 1 AS STRING)) AS chrom, CAST(n_nationkey * 150 AS BIGINT) AS start,
 CAST(n_nationkey * 150 + 200 + n_nationkey AS BIGINT) AS "end", CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_name END AS name
FROM {nation}
"""

CONTIGS = f"SELECT DISTINCT contig, CAST({CONTIG_LENGTH} AS BIGINT) AS length FROM ({ALN}) a"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view in Spark. `"end"` is a quoted name in SQL, and backticked here."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text.replace('"end"', "`end`"), **used)


def sql(text: str, **views: str) -> str:
    """DuckDB text: `views` become CTEs in order, tables are the registered views."""
    names = {t: t for t in TABLES}
    clean = lambda x: x.replace("AS STRING", "AS VARCHAR").format(**names) if any(f"{{{t}}}" in x for t in TABLES) else x.replace("AS STRING", "AS VARCHAR")
    head = ",\n".join(f"{k} AS MATERIALIZED ({clean(v)})" for k, v in views.items())
    return f"WITH {head}\n{text}"
