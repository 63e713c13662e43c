"""Structured Streaming jobs; with the availableNow trigger each gives the result of its batch form."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.hygiene import split_captures
from ..operators.keyed import KeyedTable
from ..operators.knn import nearest_batch
from ..operators.search import older_than
from ..sources.capture import events

MINUTES = "5 minutes"


def captured(spark, path: str, schema: str) -> DataFrame:
    """New files of captured messages."""
    return spark.readStream.schema(schema).parquet(path)


def keep_valid(stream: DataFrame) -> DataFrame:
    t = stream.withColumn("content", T.trim(F.col("content")))
    return t.filter(F.coalesce(F.col("content"), F.lit("")) != "")


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=MINUTES)).start()


def sync_to(stream: DataFrame, target: str, checkpoint: str, key: str = "message_id", version: str = "timestamp", once: bool = True, buckets: int = 64, last_wins: bool = True) -> StreamingQuery:
    """Upserts each micro-batch into a keyed table: it rewrites the buckets of its keys, and nothing if it is run again."""
    table = KeyedTable(stream.sparkSession, target, key, version, buckets)
    return _run(stream, lambda batch, number: table.upsert(batch, checkpoint, number, last_wins), checkpoint, once)


def current(spark, target: str) -> DataFrame | None:
    """The rows of a keyed table."""
    return KeyedTable(spark, target, "", "").read()


def save_captures(stream: DataFrame, target: str, errors: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Captured messages into a keyed table, with the time of saving (captured_at, epoch milliseconds), and those that
    can't be saved into a folder of errors, one of each micro-batch. Both sinks take a batch that is run again once."""
    table = KeyedTable(stream.sparkSession, target, "message_id", "timestamp")

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        valid, failed = split_captures(batch)
        now = F.unix_millis(F.current_timestamp())
        failed.withColumn("captured_at", now).write.mode("overwrite").parquet(f"{errors}/batch={number:010d}")
        table.upsert(valid.withColumn("captured_at", now), checkpoint, number)
        batch.unpersist()

    return _run(stream, save, checkpoint, once)


def search_stream(prompts: DataFrame, target: str, out: str, checkpoint: str, k: int = 5, threshold: float | None = 0.5, recent_seconds: int = 120, as_of: Callable[[], int] | None = None, once: bool = True) -> StreamingQuery:
    """The nearest stored messages of each prompt(vec_id, embedding), without those of the last `recent_seconds` before the
    micro-batch: its time is the limit (as_of: epoch milliseconds, the clock unless given). The store (a keyed table with
    vec_id, embedding, timestamp) is read anew by each batch, so that it may grow meanwhile."""
    spark = prompts.sparkSession

    def answer(batch: DataFrame, number: int) -> None:
        store = current(spark, target)
        if store is None:
            return
        now = as_of() if as_of else int(time.time() * 1000)
        hits = nearest_batch(store, batch, k, threshold, exclude_self=False, where=older_than(recent_seconds, now))
        hits.withColumn("as_of", F.lit(now)).write.mode("overwrite").parquet(f"{out}/batch={number:010d}")

    return _run(prompts, answer, checkpoint, once)


def dedup(stream: DataFrame, keys: list[str], ts: str, seconds: float, late: str = "1 hour") -> DataFrame:
    """Keyed state holds the time of the last kept row; a row within `seconds` of it is dropped and doesn't extend it.
    Rows of a micro-batch are taken in order of time; state goes when the watermark has passed the window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(ts, kind="stable")
        use = []
        for at in pdf[ts]:
            now = at.value // 1000
            use.append(last is None or now - last > seconds * 1e6)
            if use[-1]:
                last = now
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last // 1000 + seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pdf[use]

    return stream.withWatermark(ts, late).groupBy(*keys).applyInPandasWithState(step, stream.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_in_order(stream: DataFrame, keys: list[str], ts: str, seconds: float, late: str = "1 hour", tie: str | None = None) -> DataFrame:
    """As dedup, but rows wait in state until the watermark has passed them and are then taken in order of time (and tie),
    so that rows that come late, by up to `late`, give what the batch form gives. Rows without a time are dropped."""
    names = stream.columns
    width = int(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        for pdf in [] if state.hasTimedOut else batches:
            rank = pdf[tie] if tie else [0] * len(pdf)
            waiting += [pickle.dumps((t.value // 1000, n, tuple(row))) for t, n, row in zip(pdf[ts], rank, pdf.itertuples(index=False, name=None))]
        limit = state.getCurrentWatermarkMs() * 1000
        rows = sorted((pickle.loads(w) for w in waiting), key=lambda r: r[:2])
        kept = []
        for at, _, row in (r for r in rows if r[0] < limit):
            if last is None or at - last > width:
                last = at
                kept.append(row)
        rest = [r for r in rows if r[0] >= limit]
        if rest or (last is not None and last + width >= limit):
            state.update((last, [pickle.dumps(r) for r in rest]))
            state.setTimeoutTimestamp(max((rest[0][0] if rest else last + width) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame(kept, columns=names)

    timed = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, late)
    return timed.groupBy(*keys).applyInPandasWithState(step, stream.schema, "last long, waiting array<binary>", "append", GroupStateTimeout.EventTimeTimeout)


def lines_of_chunks(chunks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """chunks(response_id, seq, data binary, ts) -> response_id, seq, line, ts, as in capture.lines_of_chunks. A chunk waits
    in state for those before it (seq counts from 0), and what follows its last line end waits for the next. What is left
    when nothing came for `late` is a line."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, line, rest, waiting = state.get if state.exists else (0, 0, b"", [])
        waiting = {s: d for s, d in (pickle.loads(w) for w in waiting)}
        out, rest, last = [], bytes(rest), state.getCurrentWatermarkMs()
        for pdf in [] if state.hasTimedOut else batches:
            waiting |= {int(s): bytes(d) if d is not None else b"" for s, d in zip(pdf["seq"], pdf["data"]) if s >= due}
            last = max(last, int(pdf["ts"].max().value // 1_000_000))
        while due in waiting:
            *whole, rest = (rest + waiting.pop(due)).split(b"\n")
            out += [(line + k, x) for k, x in enumerate(whole)]
            line, due = line + len(whole), due + 1
        if state.hasTimedOut:
            out.append((line, rest))
            state.remove()
        else:
            state.update((due, line, rest, [pickle.dumps(w) for w in waiting.items()]))
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        rows = [(key[0], k, x.decode("utf-8", "replace").removesuffix("\r")) for k, x in out]
        rows = [r for r in rows if r[2]]
        if rows:
            yield pd.DataFrame(rows, columns=["response_id", "seq", "line"]).assign(ts=pd.Timestamp(last, unit="ms"))

    wait = int(pd.Timedelta(late).total_seconds() * 1000)
    return chunks.withWatermark("ts", late).groupBy("response_id").applyInPandasWithState(step, "response_id string, seq long, line string, ts timestamp", "due long, line long, rest binary, waiting array<binary>", "append", GroupStateTimeout.EventTimeTimeout)


def responses(lines: DataFrame, platform: str = "chatgpt", idle: str = "10 minutes") -> DataFrame:
    """lines(response_id, seq, line, ts): texts of a response are gathered in state and come out as one message at its
    end marker, or when nothing came for `idle`."""
    mark = lines.withColumn("done", F.trim("line") == "data: [DONE]").withColumn("parts", F.lit(None).cast("string"))
    found = events(lines, platform).select("response_id", "seq", "ts", "text", F.lit(False).alias("done"))
    both = found.unionByName(mark.filter("done").select("response_id", "seq", "ts", F.lit(None).cast("string").alias("text"), "done"))
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts, done = (list(v) if isinstance(v, (list, tuple)) or hasattr(v, "__len__") else v for v in state.get) if state.exists else ([], [], False)
        if not state.hasTimedOut:
            for pdf in batches:
                for s, t, d in zip(pdf["seq"], pdf["text"], pdf["done"]):
                    done = done or bool(d)
                    if isinstance(t, str):
                        seqs.append(int(s))
                        texts.append(t)
            if not done:
                state.update((seqs, texts, False))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + wait)
                return
        if state.exists:
            state.remove()
        text = "".join(t for _, t in sorted(zip(seqs, texts))).strip()
        if text:
            yield pd.DataFrame({"response_id": [key[0]], "content": [text], "role": ["assistant"]})

    out = "response_id string, content string, role string"
    return both.withWatermark("ts", idle).groupBy("response_id").applyInPandasWithState(step, out, "seqs array<long>, texts array<string>, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def health(stream: DataFrame, width: str = MINUTES, late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select(F.col("w.start").alias("start"), "n", "errors")


def usage_alerts(sizes: DataFrame, quota: int = 10_485_760, percent: float = 80) -> DataFrame:
    """sizes(ts, bytes): states of a store that use over so much of its quota."""
    used = F.col("bytes") * 100.0 / quota
    return sizes.filter(used > percent).withColumn("percent", F.round(used, 1))


def silence_alerts(stream: DataFrame, key: str, minutes: float = 10, late: str = "1 minute") -> DataFrame:
    """(key, since) where nothing came for so many minutes of event time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "since": [pd.Timestamp(last, unit="ms")]})
            return
        last = max([int(p["ts"].max().value // 1_000_000) for p in batches] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + int(minutes * 60_000), state.getCurrentWatermarkMs() + 1))

    kind = dict(stream.dtypes)[key]
    return stream.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, since timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
