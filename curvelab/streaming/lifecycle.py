"""Extraction jobs as a stream of states: the newest of each job is kept, and a job that stays unfinished for too long fails by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curvelab.operators.jobs import STATUSES

# fixed values: seconds that a job may take, and what is said of one that takes longer
LIMIT, TIMED_OUT = 300, "timed out"
OPEN = ("pending", "processing")
#: Groups of jobs by hash. A group's jobs share a call and a state: a call for every job takes milliseconds each.
GROUPS = 512
_STATE = "jobs binary"
_NAMES = np.array(sorted(STATUSES), object)  # statuses are numbered as they sort
_FAILED, _OPEN = int(np.flatnonzero(_NAMES == "failed")[0]), np.isin(_NAMES, OPEN)
_NEVER = np.iinfo(np.int64).max


def _last(rows: pd.DataFrame) -> pd.DataFrame:
    """The newest row of each job."""
    return rows.sort_values(["at", "code"], kind="stable").drop_duplicates("job_id", keep="last")


def _packed(jobs: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(jobs, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def newest(events: DataFrame, limit: int = LIMIT, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """(job_id, status, updated_at, error_message): a row each time a job's newest state changes.

    events: a stream of (job_id, status, updated_at timestamp); of equal times the status that sorts last is the newest, as in ``jobs.latest``. Event time
    decides: once the watermark (the newest event less ``late``) passes ``limit`` seconds after an open job's last state, the job has failed at that
    moment. Events older than the job's newest change nothing; one that arrives after the time-out and is newer than it opens the job again. Null job_ids and times, and states unknown, are left out.
    """
    kind = events.schema["job_id"].dataType.simpleString()
    seen = events.where(F.col("job_id").isNotNull() & F.col("updated_at").isNotNull() & F.col("status").isin(*STATUSES)).select("job_id", "status", F.col("updated_at").cast("timestamp").alias("updated_at"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        old = pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas() if state.exists else None
        new = None
        if not state.hasTimedOut:
            for f in frames:
                rows = pd.DataFrame({"job_id": f["job_id"], "at": f["updated_at"].astype("datetime64[us]").astype("int64"), "code": np.searchsorted(_NAMES, f["status"].to_numpy(object)), "due": _NEVER})
                new = _last(rows if new is None else pd.concat([new, rows]))
        shown = []
        if old is not None:
            # a job's timer goes off where the batch brings nothing of it
            silent = ~old["job_id"].isin(new["job_id"]) if new is not None else True
            over = (old["due"] < mark) & silent
            old.loc[over, "at"] += limit * 1_000_000
            old.loc[over, ["code", "due"]] = _FAILED, _NEVER
            shown.append(old[over].assign(error_message=TIMED_OUT))
        if new is not None:
            # a timer must lie ahead of the watermark; one that is due goes off with the next batch
            met = new if old is None else _last(pd.concat([old[~silent].assign(held=True), new.assign(held=False)]))
            changed = met if old is None else met[~met["held"].astype(bool)]
            if old is not None:
                # an event that says what is known already changes nothing
                known = old[~silent].merge(changed, on=["job_id", "at", "code"])["job_id"]
                changed = changed[~changed["job_id"].isin(known)]
            met = met.drop(columns="held", errors="ignore")
            met["due"] = np.where(_OPEN[met["code"]], np.maximum(met["at"] // 1000 + limit * 1000, mark + 1), _NEVER)
            shown.append(changed.assign(error_message=None))
            old = met if old is None else pd.concat([old[silent], met])
        state.update((_packed(old),))
        due = int(old["due"].min())
        if due < _NEVER:
            state.setTimeoutTimestamp(max(due, 1))
        for rows in shown:
            if len(rows):
                yield pd.DataFrame({"job_id": rows["job_id"], "status": _NAMES[rows["code"]], "updated_at": pd.to_datetime(rows["at"], unit="us"), "error_message": rows["error_message"]})

    out = f"job_id {kind}, status string, updated_at timestamp, error_message string"
    dealt = seen.withWatermark("updated_at", late).withColumn("_group", F.pmod(F.xxhash64("job_id"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandasWithState(run, out, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
