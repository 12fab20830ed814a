"""Streams: bounded deduplication, values with a time to live, and token streams of language models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..shared import unused


def unseen(stream: DataFrame, fingerprint: str, ts: str, delay: str) -> DataFrame:
    """The first row of each fingerprint within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([fingerprint])


def run_once(stream: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """Drains a stream into Parquet files under path (with its progress beside them) and reads them back."""
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
    (writer.queryName(name) if name else writer).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


#: Bytes of the row groups of a slice's file, by which the tasks of a micro-batch share it.
ROW_GROUP = 8 << 20


def replay(rows: DataFrame, ts: str, every: str, path: str) -> DataFrame:
    """A table as a stream that brings one slice of time with each micro-batch, in order: rows are written slice by slice under path first.

    every: the width of a slice, a whole number of seconds ("6 hours"). Rows without a time are left out: no watermark can judge them."""
    spark = rows.sparkSession
    seconds = spark.range(1).select(F.expr(f"unix_seconds(timestamp'1970-01-01 00:00:00Z' + interval {every})")).first()[0]
    dated = rows.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    slice_ = unused(rows, "slice")
    dated.withColumn(slice_, F.floor(F.unix_micros(ts) / (seconds * 1_000_000))).hint("rebalance", slice_).write.partitionBy(slice_).parquet(f"{path}/slices")
    slices = [r[0] for r in spark.read.parquet(f"{path}/slices").select(slice_).distinct().orderBy(slice_).collect()]  # one number for each micro-batch to come
    for i, value in enumerate(slices):  # files are read in the order in which they were finished
        spark.read.schema(dated.schema).parquet(f"{path}/slices/{slice_}={value}").coalesce(1).write.option("parquet.block.size", ROW_GROUP).mode("append").parquet(f"{path}/batches")
    return spark.readStream.schema(dated.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/batches")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a stream of files: a file, or a folder of files, named name.parquet."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def latest_within(rows: DataFrame, key: str, ts: str, tie: str, seconds: int, now: str | None = None) -> DataFrame:
    """The latest row of each key that is younger than the time to live, seen from `now` or from the table's last moment."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns)), F.struct(ts, tie)).alias("r")).select("r.*")
    if now is not None:
        return newest.where(F.col(ts) > F.to_timestamp(F.lit(now)) - F.make_dt_interval(secs=F.lit(seconds)))
    last = rows.agg(F.max(ts).alias("_last"))
    return newest.crossJoin(F.broadcast(last)).where(F.col(ts) > F.col("_last") - F.make_dt_interval(secs=F.lit(seconds))).drop("_last")


#: Groups that the keys of `lives` are dealt to: what Python is called for follows from them, not from the keys.
BUCKETS = 256


def _packed(keys: np.ndarray, at: np.ndarray) -> bytes:
    sink, table = pa.BufferOutputStream(), pa.table({"key": pa.array(keys, from_pandas=True), "at": pa.array(at, pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _lives(key: str, millis: int):
    """Rows of a bucket of keys, whose live values are its state: each key with the time of its last renewal."""

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        asked = [] if state.hasTimedOut else [b[[key, "at_ms"]] for b in batches]
        known = 0 if kept is None else len(kept)
        both = pd.concat([*([] if kept is None else [kept.set_axis([key, "at_ms"], axis=1)]), *asked], ignore_index=True)
        code, at = pd.factorize(both[key], use_na_sentinel=False)[0], both["at_ms"].to_numpy(np.int64)
        new = np.arange(len(at)) >= known
        order = np.lexsort((at, new, code))  # of each key its value first, then its rows by time
        code, at, new = code[order], at[order], new[order]
        same, watermark = code[1:] == code[:-1], state.getCurrentWatermarkMs()
        alive = np.concatenate([[False], same & (at[1:] - at[:-1] < millis)])
        last = np.append(~same, True)
        over = np.append(same & ~alive[1:], False) | (last & (at + millis <= watermark))  # not renewed in time
        told, what = np.concatenate([np.flatnonzero(new), np.flatnonzero(over)]), np.where(alive[new], "hit", "miss")
        left = np.flatnonzero(last & ~over)
        if len(left):
            state.update((_packed(both[key].to_numpy()[order[left]], at[left]),))
            # a state is called on once the watermark is beyond its time: with the first end, that is
            state.setTimeoutTimestamp(max(1, int(at[left].min()) + millis - 1))
        else:
            state.remove()
        yield pd.DataFrame({key: both[key].to_numpy()[order[told]], "at_ms": at[told], "what": np.concatenate([what, np.full(int(over.sum()), "expired")])})

    return run


def lives(stream: DataFrame, key: str, ts: str, seconds: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, at_ms, what) of a stream of rows that each ask for their key's value and renew it: "hit" where it was younger than the time to live,
    "miss" where there was none, and "expired", with the time of its last renewal, once for each value that was not renewed in time.

    The state of a key is one number. It goes when the watermark, `delay` behind the latest time, has passed the value's end, so that what is
    kept follows from the keys of one time to live, not from all that ever came. Rows behind the watermark, and rows without key or time, take
    no part. Keys are dealt to so many buckets, each of which a task looks at as one table: its rows of a micro-batch and its live values.
    Sets the session's state store to RocksDB, so that states are not held in the memory of executors."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    bucket = unused(stream, "bucket")
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias(bucket), F.col(key).alias(key), ts, F.unix_millis(ts).alias("at_ms"))
    kind = stream.schema[key].dataType.simpleString()
    return dealt.groupBy(bucket).applyInPandasWithState(_lives(key, seconds * 1000), f"{key} {kind}, at_ms long, what string", "live binary", "append", "EventTimeTimeout")


def cache_stats(rows: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """One row: what a cache with a time to live holds at the table's last moment: entries, live and expired ones, and rows that found theirs
    live when they came (hits) or did not (misses). An entry lives from its last row on."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    met = rows.select(F.col(key).alias("key"), F.col(ts).alias("at"), before.alias("before"))
    ttl = F.make_dt_interval(secs=F.lit(seconds))
    hit = F.col("before").isNotNull() & (F.col("at") - F.col("before") < ttl)
    each = met.groupBy("key").agg(F.max("at").alias("last"), F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    total = each.agg(F.max("last").alias("now"))
    live = F.col("last") > F.col("now") - ttl
    return each.crossJoin(F.broadcast(total)).agg(
        F.count("*").alias("entries"), F.count_if(live).alias("live"), F.count_if(~live).alias("expired"), F.sum("hits").alias("hits"), F.sum(F.col("n") - F.col("hits")).alias("misses")
    )


def event_tokens(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines that carry something, with its token, or done = true for the end of a stream; other and malformed lines are passed over.

    Works on streams, too: it looks at one line at a time."""
    data = F.trim(F.regexp_extract(line, "^data:(.*)$", 1))
    token = F.get(F.from_json(data, "choices array<struct<delta: struct<content: string>>>")["choices"], F.lit(0))["delta"]["content"]
    found = lines.where(F.col(line).startswith("data:")).withColumn("token", token).withColumn("done", data == "[DONE]")
    return found.where("done or token is not null")


def stream_text(lines: DataFrame, by: str = "stream_id", order: str = "pos", line: str = "line") -> DataFrame:
    """(by, answer): text that the event lines of each stream carry up to [DONE], for a table of lines."""
    found = event_tokens(lines, line)
    done = found.where("done").groupBy(by).agg(F.min(order).alias("_end"))
    before = found.where("not done").join(done, by, "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    listed = F.array_sort(F.collect_list(F.struct(order, "token")))
    return before.groupBy(by).agg(listed.alias("l")).select(by, F.array_join(F.transform("l", lambda x: x["token"]), "").alias("answer"))


def growing_text(lines: DataFrame, by: str = "stream_id", order: str = "pos", line: str = "line", ts: str = "ts", idle: str = "10 minutes") -> DataFrame:
    """(by, answer, done): the text of each stream of lines so far, a row whenever a micro-batch adds to it. lines is a stream; ts its time.

    Lines of one micro-batch are put in order; across micro-batches they are taken as they come, as a source that tells tokens does: a line that
    comes a micro-batch late is appended at the end.

    State is kept for streams that have not ended, and dropped once the watermark is `idle` past their last line."""

    def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, ended = state.get if state.exists else ("", False)
        if state.hasTimedOut:
            state.remove()
            return
        latest = 0
        for rows in [pd.concat(list(batches)).sort_values("_order", kind="stable")]:
            latest = int(rows["_ms"].max())
            for token, done in zip(rows["token"], rows["done"]):
                if done:
                    ended = True
                if ended:
                    break
                text += token
        state.update((text, ended))
        if latest + 1 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(latest + 1)
        yield pd.DataFrame({by: [key[0]], "answer": [text], "done": [ended]})

    found = event_tokens(lines.withWatermark(ts, idle), line)
    rows = found.select(by, F.col(order).alias("_order"), F.coalesce("token", F.lit("")).alias("token"), "done", F.unix_millis(ts).alias("_ms"), ts)
    kind = lines.schema[by].dataType.simpleString()
    return rows.groupBy(by).applyInPandasWithState(grow, f"{by} {kind}, answer string, done boolean", "text string, ended boolean", "update", "EventTimeTimeout")


def answer_of(response: str):
    """The answer within a response that isn't streamed, empty if there is none."""
    return F.trim(F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.lit("")))
