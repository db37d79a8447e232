"""MinHash near-duplicate groups of documents by a chosen-path similarity join.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a document's set holds its
distinct runs of five words (fewer words: all of them as one). Equal sets are one node; the
join of ``chosen_path`` links different sets of similarity 0.75 or more, confirmed on full
sets; components of links are the groups.

Defined results: null and wordless texts have the empty set, are linked with nothing and are
their own component; a null id is never a component's name, and such a row is kept with a
null component unless it shares one; repeated rows are in one group; an empty table gives an
empty table; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm import chosen_path
from credlake.llm.common import minwise, seeds, shingle_set, written, written_narrow

HASHES = 64
WORDS = 5


def signed(docs: DataFrame, hashes: int = HASHES, words: int = WORDS) -> DataFrame:
    """(doc_id, key, n, sig): name, size and minwise hashes of each text's set (key and sig null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = seeds(hashes, 1)
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary())
            for at in range(0, len(texts), 256):
                sets = [shingle_set(t.as_py(), words) for t in texts[at : at + 256]]
                n = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                sig = iter(minwise(np.concatenate(full), np.cumsum([0, *map(len, full)]), chosen) if full else ())
                keys = [chosen_path.set_key(s) if len(s) else None for s in sets]
                sigs = [next(sig).astype("<u4").tobytes() if len(s) else None for s in sets]
                yield pa.record_batch([batch.column(0)[at : at + 256], pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "key", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key bigint, n bigint, sig binary")


def groups(docs: DataFrame, trees: int = chosen_path.TREES, similarity: int = chosen_path.SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    sets = written(signed(docs), "sets")
    named = sets.where("key is not null and doc_id is not null")
    holder = written_narrow(named.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "holders")
    items = written(named.join(holder, ["key", "doc_id"], "left_semi").dropDuplicates(["key"]).select("key", "n", "sig"), "items")

    def fetch(wanted: DataFrame) -> DataFrame:
        return wanted.join(holder, "key").join(docs.select("doc_id", "text"), "doc_id")

    labels = chosen_path.linked(items, fetch, trees, similarity, WORDS)
    of_set = written_narrow(
        holder.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component")), "labelled"
    )
    smallest = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = of_set.join(smallest, "component").select("key", "component_id")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    rows = sets.select("doc_id", "key", "n").join(of_set, "key", "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
