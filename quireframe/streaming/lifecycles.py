"""Long-running lifecycles as keyed state: captures, task runs, admission to one slot, and routed sessions.

Each is a fold over a key's events, written once and used by a stream, which keeps
its state between batches, and by a batch form over a whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# How a task run ends by its outcome, and states in which a job still works.
FINAL = {"complete": "COMPLETED", "cancel": "CANCELLED", "fail": "FAILED"}
ACTIVE = ("QUEUED", "WAITING_RESOURCES", "STARTING", "RUNNING", "CANCEL_REQUESTED")
Fold = Callable[[tuple, pd.DataFrame], tuple[tuple, list[tuple]]]


def _streamed(events: DataFrame, key: str, fold: Fold, start: tuple, out: str, state: str) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        current = tuple(held.get) if held.exists else start
        after, rows = fold(current, pd.concat(list(batches)))
        held.update(after)
        yield pd.DataFrame([(*k, *r) for r in rows], columns=names)

    return events.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def _replayed(events: DataFrame, key: str, fold: Fold, start: tuple, out: str) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]

    def run(k: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*k, *r) for r in fold(start, df)[1]], columns=names)

    return events.groupBy(key).applyInPandas(run, out)


CAPTURES, CAPTURE_STATE = "workspace long, seq long, run long, state string", "run long, deadline double, seen double, interval double"


def captures(current: tuple, events: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """Events (seq, action, at, interval, duration): one running capture at a time.

    A start while one runs and lives is answered by it. A capture is gone once its deadline has passed (expired), or
    once no sample has come for five seconds or three intervals, whichever is longer (interrupted).
    """
    run, deadline, seen, interval = current
    out = []
    for e in events.sort_values("seq").itertuples():
        if run >= 0:
            ended = "expired" if e.at >= deadline else "interrupted" if e.at - seen > max(5.0, 3 * interval) else None
            if ended:
                out.append((e.seq, run, ended))
                run = -1
        if e.action == "start" and run < 0:
            if not (0.2 <= e.interval <= 60 and 1 <= e.duration <= 604_800):
                out.append((e.seq, -1, "rejected"))
                continue
            run, deadline, seen, interval = int(e.seq), e.at + e.duration, e.at, e.interval
            out.append((e.seq, run, "running"))
        elif e.action == "start":
            out.append((e.seq, run, "shared"))
        elif e.action == "sample" and run >= 0:
            seen = e.at
        elif e.action == "stop" and run >= 0:
            out.append((e.seq, run, "stopped"))
            run = -1
    return (run, float(deadline), float(seen), float(interval)), out


def capture_stream(events: DataFrame) -> DataFrame:
    return _streamed(events, "workspace", captures, (-1, 0.0, 0.0, 0.0), CAPTURES, CAPTURE_STATE)


def capture_log(events: DataFrame) -> DataFrame:
    return _replayed(events, "workspace", captures, (-1, 0.0, 0.0, 0.0), CAPTURES)


TASKS, TASK_STATE = "task long, seq long, state string, jobs int", "state string, outcome string, calls string, jobs string"


def task_runs(current: tuple, events: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """Events (seq, action, ref, value): a run that is asked to end closes once its calls have left and its jobs are done.

    Actions are enter and leave (a call), job (its state; a shared one counts as done when the run is cancelled) and end
    (an outcome). The receipt is given once; nothing enters a run that closes; another outcome is a conflict.
    """
    state, outcome, calls, jobs = current
    waiting = set(filter(None, calls.split(",")))
    held = dict(x.split("=") for x in jobs.split(",") if x)
    out = []
    for e in events.sort_values("seq").itertuples():
        ref = str(e.ref)
        if e.action == "enter":
            if state == "OPEN":
                waiting.add(ref)
            else:
                out.append((e.seq, "TASK_RUN_NOT_OPEN", len(held)))
        elif e.action == "leave":
            waiting.discard(ref)
        elif e.action == "job":
            held[ref] = e.value
        elif e.action == "end":
            if e.value not in FINAL:
                out.append((e.seq, "INVALID_TASK_RUN_ACTION", len(held)))
            elif state == "OPEN":
                state, outcome = "CLOSING", e.value
            elif outcome != e.value:
                out.append((e.seq, "TASK_RUN_OUTCOME_CONFLICT", len(held)))
        busy = [s for s in held.values() if s.removesuffix("+shared") in ACTIVE and not (outcome == "cancel" and s.endswith("+shared"))]
        if state == "CLOSING" and not waiting and not busy:
            state = FINAL[outcome]
            out.append((e.seq, state, len(held)))
    return (state, outcome, ",".join(sorted(waiting)), ",".join(f"{k}={v}" for k, v in sorted(held.items()))), out


def task_stream(events: DataFrame) -> DataFrame:
    return _streamed(events, "task", task_runs, ("OPEN", "", "", ""), TASKS, TASK_STATE)


def task_log(events: DataFrame) -> DataFrame:
    return _replayed(events, "task", task_runs, ("OPEN", "", "", ""), TASKS)


SLOTS, SLOT_STATE = "slot long, seq long, job long, state string", "running long, queue string"


def admission(current: tuple, events: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """Events (seq, action, job, at, deadline): one heavy job at a time, the oldest first; what waits too long expires."""
    running, queue = current
    waiting = [tuple(map(float, x.split(":"))) for x in queue.split(",") if x]
    out = []
    for e in events.sort_values("seq").itertuples():
        if e.action == "submit":
            waiting.append((float(e.job), float(e.deadline)))
            out.append((e.seq, e.job, "QUEUED"))
        elif e.action == "finish" and running == e.job:
            out.append((e.seq, e.job, "FINISHED"))
            running = -1
        late = [w for w in waiting if w[1] <= e.at]
        out += [(e.seq, int(j), "WAIT_EXPIRED") for j, _ in late]
        waiting = [w for w in waiting if w not in late]
        if running < 0 and waiting:
            running = int(waiting.pop(0)[0])
            out.append((e.seq, running, "ADMITTED"))
    return (int(running), ",".join(f"{j}:{d}" for j, d in waiting)), out


def admission_stream(events: DataFrame) -> DataFrame:
    """One slot is one key: its events are taken one after another on purpose."""
    return _streamed(events, "slot", admission, (-1, ""), SLOTS, SLOT_STATE)


def admission_log(events: DataFrame) -> DataFrame:
    return _replayed(events, "slot", admission, (-1, ""), SLOTS)


SESSIONS, SESSION_STATE = "gateway long, seq long, session string, answer string", "session string, role string, closed string"


def routed(current: tuple, events: pd.DataFrame, remembered: int = 64) -> tuple[tuple, list[tuple]]:
    """Events (seq, action, session, role): one open session; closed ones are remembered, the last so many of them."""
    session, role, closed = current
    gone = [x for x in closed.split(",") if x]
    out = []
    for e in events.sort_values("seq").itertuples():
        answer = "OK"
        if e.session in gone:
            answer = {"close": "RECEIPT", "open": "GATEWAY_SESSION_ALREADY_CLOSED"}.get(e.action, "GATEWAY_SESSION_CLOSED")
        elif e.action == "open":
            if session and e.session != session:
                answer = "GATEWAY_ANOTHER_SESSION_ACTIVE"
            elif session and e.role != role:
                answer = "GATEWAY_SESSION_ROLE_CHANGED"
            else:
                session, role = e.session, e.role
        elif e.session != session:
            answer = "GATEWAY_SESSION_UNKNOWN"
        elif e.action == "infer" and e.role != role:
            answer = "GATEWAY_SESSION_ROLE_CHANGED"
        elif e.action == "close":
            gone = [*gone, session][-remembered:]
            session, role = "", ""
        out.append((e.seq, e.session, answer))
    return (session, role, ",".join(gone)), out


def session_stream(events: DataFrame) -> DataFrame:
    return _streamed(events, "gateway", routed, ("", "", ""), SESSIONS, SESSION_STATE)


def session_log(events: DataFrame) -> DataFrame:
    return _replayed(events, "gateway", routed, ("", "", ""), SESSIONS)
