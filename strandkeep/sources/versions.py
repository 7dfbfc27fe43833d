"""Three versions of one workspace (base, ours, theirs), derived from the documents table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.sources.tables import table

_PATH = "concat('docs/', source, '/', lang, '/', doc_id, '.md')"
_SPARK_TEXT = {
    "base": ("doc_id % 10 <> 9", "text"),
    "ours": (
        "doc_id % 7 <> 0",
        "CASE WHEN doc_id % 15 IN (1, 6) THEN concat('ours', NL, text)"
        " WHEN doc_id % 15 = 11 OR doc_id % 20 IN (4, 14, 19) THEN concat(text, NL, 'ours')"
        " WHEN doc_id % 5 = 3 THEN concat(text, NL, 'both') ELSE text END",
    ),
    "theirs": (
        "doc_id % 11 <> 0",
        "CASE WHEN doc_id % 15 = 1 THEN concat('theirs', NL, text)"
        " WHEN doc_id % 5 IN (1, 2) THEN concat(text, NL, 'theirs')"
        " WHEN doc_id % 5 = 3 THEN concat(text, NL, 'both') ELSE text END",
    ),
}


def version(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One version as path, text. Scans only the columns it needs."""
    keep, text = _SPARK_TEXT[name]
    docs = table(spark, folder, "documents").where(keep)
    return docs.select(F.expr(_PATH).alias("path"), F.expr(text.replace("NL", "char(10)")).alias("text"))


def entries(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One version as file entries: path, size in bytes, executable, ordered chunk ids (one chunk a file)."""
    return version(spark, folder, name).select(
        "path",
        F.octet_length("text").cast("long").alias("size"),
        F.lit(False).alias("executable"),
        F.array(F.sha2("text", 256)).alias("chunks"),
    )


def version_sql(name: str) -> str:
    """The DuckDB subquery for the same rows as version()."""
    keep, text = _SPARK_TEXT[name]
    return f"(SELECT {_PATH} AS path, {text.replace('NL', 'chr(10)')} AS text FROM documents WHERE {keep})"


def entries_sql(name: str) -> str:
    return f"(SELECT path, CAST(strlen(text) AS BIGINT) AS size, false AS executable, [sha256(text)] AS chunks FROM {version_sql(name)})"
