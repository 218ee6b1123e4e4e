"""Text index: keep vectors of texts, a chunk of words each, in step with a folder of Parquet files that grows.

    python -m jobs.text_index --documents PATH --output PATH --checkpoint PATH [--config FILE]

What an agent can be asked is found by its vectors, and computing them is what indexing costs; so only what is new is
computed. A file stream takes the files that the checkpoint has not seen, whose rows are (doc_id, text, lang, source), in
batches; of their rows those whose text the index already holds for that doc_id are left out. A batch writes the folder
`batch=N` of the output, by language, over whatever a failed run left there. A run ends when all files that are there
have been taken; another run over the same files writes nothing.

A document that comes again with another text is written again; `current()` reads the chunks of its latest batch. Within
a batch repeated rows count once, and of different texts with one doc_id that with the greatest digest stays. A text
without words has one chunk without tokens, so that it takes the place of an earlier text. A null doc_id is a key like any
other. A file that is written over under its old name is not taken again: give new texts in new files.
"""

from __future__ import annotations

import logging
from functools import reduce
from pathlib import Path

from flowlens.functions import vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common

log = logging.getLogger("flowlens.jobs.text_index")
SETTINGS = str(Path(__file__).with_suffix(".json"))
#: What is known of a chunk: its place among its document's words, and how many tokens fall in each bucket of its vector.
CHUNKS = "doc_id long, source string, digest string, n_words long, chunk int, first_word long, n_tokens long, vector array<int>, batch long, lang string"
WORD = r"[^\x20\x09-\x0D]+"


def chunked(texts: DataFrame, dimension: int, chunk_words: int) -> DataFrame:
    """One row a chunk of `chunk_words` words of each row (doc_id, source, lang, digest, text), with its hashed vector."""
    words = texts.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(chunk_words))
    each = words.select("doc_id", "source", "lang", "digest", F.size("_w").cast("long").alias("n_words"), "_w", F.posexplode(starts).alias("chunk", "_s"))
    part = F.array_join(F.slice("_w", F.col("_s") + 1, chunk_words), " ")
    parts = each.select("doc_id", "source", "lang", "digest", "n_words", "chunk", F.col("_s").cast("long").alias("first_word"), part.alias("_t"))
    tokens = F.size(vectors.tokens("_t")).cast("long")
    counts = F.transform(vectors.hashed("_t", dimension, vectors.md5_bucket), lambda x: x.cast("int"))
    return parts.select("doc_id", "source", "digest", "n_words", "chunk", "first_word", tokens.alias("n_tokens"), counts.alias("vector"), "lang")


def _latest(chunks: DataFrame) -> DataFrame:
    """(doc_id, batch, digest) of the last batch that holds each document."""
    return chunks.where("chunk = 0").groupBy("doc_id").agg(F.max_by("digest", "batch").alias("digest"), F.max("batch").alias("batch"))


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns])


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of every document as it stands after the last run."""
    chunks = common.written(spark, output, CHUNKS)
    last = _latest(chunks).select("doc_id", "batch")
    return chunks.join(last, _same(chunks, last, "doc_id", "batch"), "left_semi")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: str = SETTINGS) -> dict[str, int]:
    """Index the files of `documents` (a folder of Parquet files, or one) that `checkpoint` has not seen; what was read and written."""
    settings = common.config(config, {"dimension": int, "chunk_words": int, "files_per_batch": int})
    done = {"rows": 0, "documents": 0, "chunks": 0, "batches": 0}

    def batch(rows: DataFrame, number: int) -> None:
        texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
        one = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("digest", "text", "lang", "source")).alias("_d")).select("doc_id", "_n", "_d.*")
        # earlier batches only: a batch that is run again must not find itself
        held = _latest(common.written(rows.sparkSession, output, CHUNKS).where(F.col("batch") < number))
        new = one.join(held, _same(one, held, "doc_id", "digest"), "left_anti")
        place = f"{output}/batch={number}"
        chunked(new, settings["dimension"], settings["chunk_words"]).write.mode("overwrite").partitionBy("lang").parquet(place)
        out = common.written(rows.sparkSession, output, CHUNKS).where(F.col("batch") == number).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk") == 0).alias("documents")).first()
        read = rows.count()
        log.info("batch %d: read %d rows of %s, wrote %d chunks of %d new or changed documents to %s", number, read, documents, out["chunks"], out["documents"], place)
        for name, n in (("rows", read), ("documents", out["documents"]), ("chunks", out["chunks"]), ("batches", 1)):
            done[name] += n

    schema = spark.read.parquet(documents).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"])
    if common.is_file(spark, documents):  # streams read folders
        folder, _, name = documents.rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(folder or ".")
    else:
        stream = reader.parquet(documents)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("read %(rows)d rows in %(batches)d batches, wrote %(chunks)d chunks of %(documents)d documents", done)
    return done


if __name__ == "__main__":
    common.command("text index: vectors of texts that are new", {"documents": "folder of Parquet files", "output": "folder of the index", "checkpoint": "folder of the stream's progress"}, SETTINGS, run)
