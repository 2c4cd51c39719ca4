"""A retrieval index kept in a folder, in versions.

The vocabulary is fitted once, on the first batch of documents. Each batch is written to a folder of its own; a
manifest of one file then names the batches of the new version. Readers see a version only when that file is there,
so a failed or running addition changes nothing. A document that comes again replaces its earlier chunks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.stats import materialize
from tablelens.operators import retrieval as V
from tablelens.operators.termrows import MAX_BROADCAST_IDS, exploded

MANIFEST = "version int, batch int, folder string, id_col string, text_col string, size int, overlap int"


@dataclass
class Index:
    version: int
    id_col: str
    vocabulary: DataFrame  # (term, idf)
    chunks: DataFrame  # (id, chunk_id, text, n_chars, chunk_key)
    rows: DataFrame  # (chunk_key, terms, weights)

    @property
    def weights(self) -> DataFrame:
        """(chunk_key, term, weight)"""
        return exploded(self.rows, ["chunk_key"], "weights", "weight")


def _manifest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest/*")


def _commit(spark: SparkSession, base: str, version: int, rows: list[tuple]) -> None:
    """One file in a folder named by the version; a second writer of the same version fails."""
    spark.createDataFrame([(version, *r) for r in rows], MANIFEST).coalesce(1).write.mode("error").parquet(f"{base}/manifest/v{version}")


def _write_batch(base: str, docs: DataFrame, id_col: str, chunks: DataFrame, vocabulary: DataFrame) -> str:
    folder = f"{base}/batches/{uuid.uuid4().hex}"
    chunks.write.parquet(f"{folder}/chunks")
    docs.select(id_col).distinct().write.parquet(f"{folder}/ids")
    written = docs.sparkSession.read.parquet(f"{folder}/chunks")
    # one row of terms and weights a chunk, with its document's id; only keys of several chunks (a repeated or null id) meet their ids by a join
    tf = V.term_rows(written, "chunk_key", "text", (id_col,))
    rows = V.weight_rows(tf, vocabulary)
    if tf.shared is not None or id_col not in rows.columns:
        rows = rows.drop(id_col).join(written.select("chunk_key", id_col), "chunk_key")
    rows.where(F.size("terms") > 0).select("chunk_key", id_col, "terms", "weights").write.parquet(f"{folder}/weights")
    return folder


def create(base: str, docs: DataFrame, id_col: str, text_col: str, size: int = 900, overlap: int = 120,
           max_features: int | None = 5000) -> int:
    """Version 0: the vocabulary and the first batch. An index that exists already is an error."""
    spark, base = docs.sparkSession, base.rstrip("/")
    chunks = materialize(V.keyed_chunks(docs, id_col, text_col, size, overlap))
    V.fit_idf(chunks, "chunk_key", "text", max_features).write.mode("error").parquet(f"{base}/vocabulary")
    folder = _write_batch(base, docs, id_col, chunks, spark.read.parquet(f"{base}/vocabulary"))
    _commit(spark, base, 0, [(0, folder, id_col, text_col, size, overlap)])
    return 0


def _newest(spark: SparkSession, base: str, version: int | None) -> list:
    rows = _manifest(spark, base).collect()  # one row a batch and version
    version = max(r["version"] for r in rows) if version is None else version
    own = sorted((r for r in rows if r["version"] == version), key=lambda r: r["batch"])
    if not own:
        raise ValueError(f"no version {version} in {base}")
    return own


def add(spark: SparkSession, base: str, docs: DataFrame) -> int:
    """A new version with one more batch, weighted by the stored vocabulary; nothing is fitted or written again."""
    base = base.rstrip("/")
    own = _newest(spark, base, None)
    last = own[-1]
    chunks = V.keyed_chunks(docs, last["id_col"], last["text_col"], last["size"], last["overlap"])
    folder = _write_batch(base, docs, last["id_col"], chunks, spark.read.parquet(f"{base}/vocabulary"))
    version = last["version"] + 1
    _commit(spark, base, version, [tuple(r)[1:] for r in own] + [(last["batch"] + 1, folder, *tuple(last)[3:])])
    return version


def load(spark: SparkSession, base: str, version: int | None = None) -> Index:
    """The newest version, or an earlier one. Of a document in several batches only the newest batch counts (only ids are
    compared); rows with a null id are never replaced."""
    base = base.rstrip("/")
    own = _newest(spark, base, version)
    id_col, later, parts = own[0]["id_col"], None, []
    for r in reversed(own):
        tables = [spark.read.parquet(f"{r['folder']}/{name}") for name in ("chunks", "weights")]
        ids = spark.read.parquet(f"{r['folder']}/ids")
        if later is not None:
            replaced = materialize(ids.join(later, id_col, "left_semi"))  # usually few, and then sent to every task
            n = replaced.count()
            gone = F.broadcast(replaced) if n <= MAX_BROADCAST_IDS else replaced
            tables = [t.join(gone, id_col, "left_anti") for t in tables] if n else tables
        parts.append(tables)
        later = ids if later is None else later.unionByName(ids)
    chunks, weights = parts[0]
    for c, w in parts[1:]:
        chunks, weights = chunks.unionByName(c), weights.unionByName(w)
    return Index(own[0]["version"], id_col, spark.read.parquet(f"{base}/vocabulary"), chunks, weights.drop(id_col))
