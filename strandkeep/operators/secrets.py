"""Finding secrets in file contents, in files with something new alone. The patterns are this engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "api_key": r"\b(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36})\b",
    "bearer": r"\bBearer [A-Za-z0-9._~+/-]{16,}",
    "assigned_token": r"""(?:token|secret|api_key|password) = "[0-9A-Za-z_-]{16,}\"""",
    "connection_string": r"[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@[^/\s]+",
}
MASK = r"[0-9A-Za-z_-]{8,}"


def findings(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, line (from 1), kind, excerpt (long runs of letters and digits masked): every line of a file against every kind, whole files, never single chunks."""
    lines = files.select(key, F.posexplode(F.split(content, "\n")).alias("n", "text"))
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in KINDS.items()]))
    hits = lines.withColumn("kinds", kinds).where(F.size("kinds") > 0)
    excerpt = F.substring(F.regexp_replace("text", MASK, "***"), 1, 80)
    return hits.select(key, (F.col("n") + 1).alias("line"), F.explode("kinds").alias("kind"), excerpt.alias("excerpt"))


def to_scan(entries: DataFrame, store: DataFrame) -> DataFrame:
    """The files (path, chunks) with a chunk that the store lacks: only those are scanned."""
    spread = entries.select("path", F.explode("chunks").alias("chunk_id"))
    fresh = spread.join(store.select("chunk_id"), "chunk_id", "left_anti").select("path").distinct()
    return entries.join(fresh, "path", "left_semi")
