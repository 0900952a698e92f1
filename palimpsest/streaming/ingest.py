"""A stream of full or partial versions, committed micro-batch by micro-batch.

The reference point is a batch commit; a stream adds no state of its own. Each micro-batch becomes one version: either the
batch is the whole table (`mode="replace"`), or its rows are merged into the head by key (`mode="upsert"`). Every manifest
says up to which batch each stream has been taken in, by the id that the stream's checkpoint has; a batch that is delivered
again after a failure is skipped, and streams, or messages of other commits, cannot be taken for each other. If another
writer made a version meanwhile, the batch is merged into that one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.identity import key_text
from palimpsest.plans.schema import RID, quoted
from palimpsest.repository import Repository
from palimpsest.sources.files import Files, TakenError

TRIES = 100


def stream_id(repo: Repository, checkpoint: str) -> str:
    """The id that Spark wrote into the checkpoint when the stream first started."""
    files = Files(repo.spark, checkpoint)
    return json.loads(files.read_text(files.at("metadata")).splitlines()[0])["id"]


def taken(repo: Repository, stream: str) -> int:
    """The last batch of a stream that some version holds; -1 for none."""
    head = repo.head
    return repo.metadata(head).get("streams", {}).get(stream, -1) if head else -1


def commit_batch(repo: Repository, batch: DataFrame, batch_id: int, mode: str = "upsert", stream: str = "batches") -> int | None:
    """Commit one micro-batch of the named stream; the new version, or None if it had been committed before."""
    for _ in range(TRIES):
        if taken(repo, stream) >= batch_id:
            return None
        rows = batch
        if mode == "upsert" and repo.head:
            if repo.keyless:
                raise ValueError("rows can be merged only by key")
            ids = batch.select(key_text(repo.keys).alias(RID))
            kept = repo.frame().join(ids, RID, "left_anti").drop(RID)
            rows = kept.unionByName(batch.select(*[quoted(c) for c in kept.columns]))
        try:
            return repo.commit(rows, f"batch {batch_id} of {stream}", streams={stream: batch_id}).version
        except TakenError:
            continue
    raise TakenError(f"other writers were first {TRIES} times")


def commit_stream(repo: Repository, stream: DataFrame, checkpoint: str, mode: str = "upsert", **trigger) -> StreamingQuery:
    """Start committing a streaming frame. The default trigger takes what there is and stops."""
    if not stream.isStreaming:
        raise ValueError("a streaming frame is needed")
    last = F.struct(*[F.col(c) for c in stream.columns])

    def take(batch: DataFrame, batch_id: int) -> None:
        if mode == "upsert":  # of rows of one key within a batch, the largest
            keyed = batch.groupBy(*[quoted(k) for k in repo.keys]).agg(F.max(last).alias("row"))
            batch = keyed.select("row.*")
        commit_batch(repo, batch, batch_id, mode, stream_id(repo, checkpoint))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
