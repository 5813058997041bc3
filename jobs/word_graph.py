"""word graph: grows one weighted directed graph of words for each language from a folder of documents that gets new files.

The graph stages (features, tokens, probes) take any pre, post, w table; this job makes such tables of text, one volume a
language, so that what is fitted on one language can be applied to another. Each run takes the files that its checkpoint has
not seen:

    log/batch=N/volume=V   pairs of neighbouring words of one batch with their counts; a batch that is run again replaces itself
    edges/volume=V         pre, post, w over all batches
    nodes/volume=V         word, n_in, n_out, syn_in, syn_out, tokens (its k strongest partners, best first)
    marks/volume=V         upto: the last batch that edges and nodes hold; written last

Only volumes with batches above their mark are put together again, from the log, so a run that was cut off anywhere is made
good by the next one. Documents are counted once each file; files must not change after they have been seen.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators.edges import degree_table
from graftline.operators.tokens import token_arrays, top_partners
from jobs.common import main, present

LOG = logging.getLogger("jobs.word_graph")
DEFAULTS = {"text": "text", "volume": "lang", "k": 8, "least_weight": 1, "files_per_batch": 256, "most_volumes": 1000}
#: Capital letters are lowered and these marks taken out before words are read.
MARKS = ".,;:!?()\""
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
UNKNOWN = "unknown"

LOG_SCHEMA = "pre string, post string, w long, batch long, volume string"
EDGES = "pre string, post string, w long, volume string"
NODES = "word string, n_in long, n_out long, syn_in long, syn_out long, tokens array<string>, volume string"
MARK = "upto long, n_nodes long, volume string"


def word_pairs(docs: DataFrame, text: str, volume: str) -> DataFrame:
    """(volume, pre, post): each word with the next one of its text, over line ends too. A null text has none; a null or empty volume is unknown."""
    plain = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), LETTERS + MARKS, LETTERS.lower())
    words = docs.select(F.coalesce(F.nullif(F.col(f"`{volume}`").cast("string"), F.lit("")), F.lit(UNKNOWN)).alias("volume"), F.regexp_extract_all(plain, F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    return words.select("volume", F.inline(F.arrays_zip(F.slice("w", 1, n).alias("pre"), F.slice("w", 2, n).alias("post"))).alias("pre", "post"))


def take_new(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> int:
    """Counts the pairs of files that the checkpoint has not seen, batch by batch; returns the number of batches."""
    done = []

    def keep(batch: DataFrame, number: int) -> None:
        pairs = word_pairs(batch, config["text"], config["volume"]).groupBy("volume", "pre", "post").agg(F.count(F.lit(1)).alias("w"))
        path = f"{out}/log/batch={number}"
        pairs.write.mode("overwrite").partitionBy("volume").parquet(path)
        done.append(number)
        LOG.info("batch %d: wrote %s", number, path)

    schema = spark.read.parquet(documents).schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    stream = new.select(*dict.fromkeys((config["text"], config["volume"]))).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    read = sum(p["numInputRows"] for p in stream.recentProgress)
    LOG.info("read %d new rows of %s in %d batches", read, documents, len(done))
    return len(done)


def behind(spark: SparkSession, out: str, most: int) -> dict[str, tuple[int, int]]:
    """The first and the last batch of each volume that has batches above its mark. A volume is one row; more than most of them are refused."""
    last = present(spark, f"{out}/log", LOG_SCHEMA).groupBy("volume").agg(F.min("batch").alias("first"), F.max("batch").alias("last"))
    rows = last.join(present(spark, f"{out}/marks", MARK), "volume", "left").where("upto IS NULL OR upto < last").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} volumes; set most_volumes or another volume column")
    return {r.volume: (r["first"], r.last) for r in rows}


def put_together(spark: SparkSession, out: str, volumes: dict[str, tuple[int, int]], config: dict) -> None:
    """Edges, nodes and marks of the given volumes from the whole log; other volumes' folders are not touched."""
    if not volumes:
        LOG.info("no volume has new batches")
        return

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("volume").parquet(f"{out}/{name}")
        LOG.info("wrote %s/%s of volumes %s", out, name, ", ".join(sorted(volumes)))

    here = F.col("volume").isin(*volumes)
    end = lambda c: F.concat_ws(" ", "volume", c).alias(c)  # noqa: E731  the same word of two volumes is two nodes; no word holds a space
    word = lambda c: F.substring_index(c, " ", -1)
    volume = lambda c: F.expr(f"left({c}, length({c}) - length(substring_index({c}, ' ', -1)) - 1)").alias("volume")
    log = present(spark, f"{out}/log", LOG_SCHEMA).where(here)
    one = F.col("volume").isin(*(v for v, (first, last) in volumes.items() if first == last))  # a batch's pairs are added up already
    added = log.where(~one).groupBy("pre", "post", "volume").agg(F.sum("w").alias("w")).select("pre", "post", "w", "volume")
    edges = added.unionByName(log.where(one).select("pre", "post", "w", "volume")).where(F.col("w") >= config["least_weight"])
    write(edges.select("pre", "post", "w", "volume"), "edges")
    edges = present(spark, f"{out}/edges", EDGES).where(here).select(end("pre"), end("post"), "w")
    tokens = token_arrays(top_partners(edges, config["k"])).select("id", F.transform("tokens", lambda t: word(t["partner"])).alias("tokens"))
    write(degree_table(edges).join(tokens, "id").select(word("id").alias("word"), "n_in", "n_out", "syn_in", "syn_out", "tokens", volume("id")), "nodes")
    upto = F.create_map(*(F.lit(x) for v, (_, last) in volumes.items() for x in (v, last)))
    write(present(spark, f"{out}/nodes", NODES).where(here).groupBy("volume").agg(F.count(F.lit(1)).alias("n_nodes")).select(upto[F.col("volume")].cast("long").alias("upto"), "n_nodes", "volume"), "marks")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """One run; returns the batches taken and the volumes put together."""
    config, out = DEFAULTS | (config or {}), out.rstrip("/")
    batches = take_new(spark, documents, out, checkpoint, config)
    volumes = behind(spark, out, config["most_volumes"])
    put_together(spark, out, volumes, config)
    return {"batches": batches, "volumes": sorted(volumes)}


def output(spark: SparkSession, out: str) -> DataFrame:
    """Edges and nodes as they stand, as one table: kind, volume, pre, post, w of edges; kind, volume, pre (the word), degrees and tokens of nodes."""
    edges = present(spark, f"{out}/edges", EDGES).select(F.lit("edge").alias("kind"), "volume", "pre", "post", "w")
    nodes = present(spark, f"{out}/nodes", NODES).select(F.lit("node").alias("kind"), "volume", F.col("word").alias("pre"), "n_in", "n_out", "syn_in", "syn_out", F.array_join("tokens", " ").alias("tokens"))
    return edges.unionByName(nodes, allowMissingColumns=True)


if __name__ == "__main__":
    main(run, "word graph: grows a graph of words for each language from a folder of documents", DEFAULTS, {"documents": "folder of Parquet files, or a pattern for some", "out": "folder of the job's tables", "checkpoint": "folder of the stream's checkpoint"})
