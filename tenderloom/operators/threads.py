"""Messages and the dispatches that they answer: one-to-one assignment in order
of arrival, and the best dispatch chain within an interval.

The assignment depends on what was assigned before, so a workflow's rows are one
sorted run; it is a fold whose state holds the workflow's pending dispatches and
nothing of the responses, the same in batch and as a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A response goes to a dispatch from this score on; the last pending one has its own.
LEAST, SOLE = 0.45, 0.55
NEAR_SECONDS = 72 * 3600
_ROWS = "workflow_id string, sent boolean, ts timestamp, id string, unique_id string, subject string, domain string, headers array<string>"
_FOUND = "workflow_id string, response_id string, unique_id string, score double, how string"


class Workflow:
    """The pending dispatches of one workflow, found by headers, subject and domain."""

    def __init__(self, told: str | None = None):
        self.pending, self.every, self.by = {}, set(), {}
        for row in json.loads(told) if told else []:
            self.register(*row[:4], row[4], pending=row[5])

    def told(self) -> str:
        return json.dumps([[i, *self.pending[i], True] if i in self.pending else [i, None, None, None, [], False] for i in sorted(self.every)])

    def register(self, unique_id: str, ts: float, subject: str | None, domain: str | None, headers: list[str], pending: bool = True) -> None:
        if unique_id in self.every:
            return
        self.every.add(unique_id)
        if pending:
            self.pending[unique_id] = (ts, subject, domain, headers)
            for key in self._keys(subject, domain, headers):
                self.by.setdefault(key, set()).add(unique_id)

    @staticmethod
    def _keys(subject, domain, headers) -> list[tuple]:
        return [("h", h) for h in headers] + [(k, v) for k, v in (("s", subject), ("d", domain)) if v is not None]

    def _use(self, unique_id: str) -> None:
        _, *keys = self.pending.pop(unique_id)
        for key in self._keys(*keys):
            self.by[key].discard(unique_id)

    def _score(self, unique_id: str, ts: float, subject, domain, headers) -> float:
        sent, own_subject, own_domain, own_headers = self.pending[unique_id]
        if not set(own_headers).isdisjoint(headers):
            return 1.0
        same = lambda a, b: a is not None and a == b
        return min(0.3 + 0.4 * same(own_subject, subject) + 0.25 * same(own_domain, domain) + 0.15 * (abs(ts - sent) <= NEAR_SECONDS), 1.0)

    def assign(self, unique_id, ts: float, subject, domain, headers: list[str]) -> tuple[str, float, str] | None:
        """What a response goes to. A dispatch that it names is taken even twice."""
        if unique_id is not None and unique_id in self.every:
            if unique_id in self.pending:
                self._use(unique_id)
            return unique_id, 1.0, "unique-id"
        before = len(self.pending) < len(self.every)
        some = set().union(*(self.by.get(key, ()) for key in self._keys(subject, domain, headers)))
        # Nothing in common but the workflow: nearness alone suffices, for the first in order.
        near = min((i for i, row in self.pending.items() if i not in some and abs(ts - row[0]) <= NEAR_SECONDS), default=None) if not some else None
        best = min(((-round(self._score(i, ts, subject, domain, headers), 4), i) for i in some | ({near} - {None})), default=None)
        if best and -best[0] >= LEAST:
            self._use(best[1])
            return best[1], -best[0], "score"
        if len(self.pending) == 1:
            only, (_, _, own_domain, _) = next(iter(self.pending.items()))
            if not before or (domain is not None and domain == own_domain):
                self._use(only)
                return only, SOLE, "sole"
        return None


def _rows(dispatches: DataFrame, responses: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    headers = F.filter(F.transform(F.coalesce("headers", F.array().cast("array<string>")), lambda h: F.lower(F.btrim(h, F.lit("<> ")))), lambda h: h != "").alias("headers")
    common = [text("workflow_id"), F.lit(True).alias("sent"), F.col("ts").cast("timestamp").alias("ts")]
    sent = dispatches.where("unique_id is not null").select(*common, F.col("unique_id").cast("string").alias("id"), text("unique_id"), text("subject"), text("domain"), headers)
    common[1] = F.lit(False).alias("sent")
    got = responses.where("response_id is not null").select(*common, F.col("response_id").cast("string").alias("id"), text("unique_id"), text("subject"), text("domain"), headers)
    return sent.unionByName(got).where("workflow_id is not null and ts is not null")


def _fold(state: Workflow, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, unique_id, score, how) of the responses among rows, dispatches first."""
    for _, sent, ts, i, unique_id, subject, domain, headers in rows:
        if sent:
            state.register(unique_id, ts, subject, domain, list(headers))
        elif (found := state.assign(unique_id, ts, subject, domain, list(headers))) is not None:
            yield i, *found


def assign_responses(dispatches: DataFrame, responses: DataFrame) -> DataFrame:
    """workflow_id, response_id, unique_id, score, how: each response, in order of
    ts and response_id, with a dispatch of its workflow.

    Both have workflow_id, unique_id (of a response: the one it names), subject,
    domain, headers (message ids), ts; responses have response_id. A named
    dispatch scores 1; else the best dispatch that none has taken yet: headers in
    common 1, else the workflow 0.3, subject 0.4, domain 0.25 and 72 hours 0.15, at
    most 1; ties by unique_id; from 0.45 on. Else the only pending one, if it has
    the domain or nothing is assigned yet (0.55). Responses without any are left
    out, as are rows without workflow, id or ts. A task sees its workflows one
    after another and holds one's pending dispatches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workflow, state = None, None
        for b in batches:
            columns = [b.column(c).to_pylist() if c != 2 else [t.value / 1e6 for t in b.column(c).cast(pa.timestamp("us"))] for c in range(8)]
            out = []
            for row in zip(*columns, strict=True):
                if row[0] != workflow:
                    workflow, state = row[0], Workflow()
                out += [(workflow, *found) for found in _fold(state, [row])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()))], ["workflow_id", "response_id", "unique_id", "score", "how"])

    rows = _rows(dispatches, responses)
    return rows.repartition("workflow_id").sortWithinPartitions("workflow_id", F.desc("sent"), "ts", "id").mapInArrow(run, _FOUND)


def assign_stream(rows: DataFrame) -> DataFrame:
    """The same over a stream of dispatches and responses (columns of `message_rows`):
    the state of a workflow lives as long as it has pending dispatches. Equals the
    batch version if dispatches come before the responses, and these in order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        flow = Workflow(state.get[0] if state.exists else None)
        every = pd.concat(list(frames)).sort_values(["sent", "ts", "id"], ascending=[False, True, True])
        every["ts"] = every["ts"].astype("datetime64[us]").astype("int64") / 1e6
        found = list(_fold(flow, (tuple(None if x is None or x is pd.NA else x for x in r) for r in every.itertuples(index=False))))
        state.update((flow.told(),))
        yield pd.DataFrame([(key[0], *f) for f in found], columns=["workflow_id", "response_id", "unique_id", "score", "how"])

    return rows.groupBy("workflow_id").applyInPandasWithState(run, _FOUND, "told string", "append", "NoTimeout")


def message_rows(dispatches: DataFrame, responses: DataFrame) -> DataFrame:
    """Dispatches and responses as rows of one stream."""
    return _rows(dispatches, responses)


#: Parts of the interval that chains are summed up in before they meet messages.
PARTS = 24


def best_chains(messages: DataFrame, chains: DataFrame, days: int = 5) -> DataFrame:
    """message_id, chain_id, via, score: the chain that a message belongs to.

    messages (message_id, ts, refs, supplier_id, mailbox), chains (chain_id,
    supplier_id, mailbox, thread_index, created, awaiting). Of awaiting chains whose
    mailbox is unknown or the message's (any, if it has none): one that refs name
    (0.75), else one created within `days` before the message, of its supplier
    (0.7), or of any if it names none (0.6). Larger thread_index, later created,
    then larger chain_id goes first. Messages without any are left out.

    No chain meets a message: time is cut into parts of the interval, and chains and
    messages of a part are one sorted run. The best chain so far is that of the part
    at the interval's end, the best from there on that of the part at its start; the
    best of the parts between comes first in the run of the later one.
    """
    open_ = chains.where("awaiting and chain_id is not null").select("chain_id", F.lower(F.col("supplier_id").cast("string")).alias("c_supplier"), F.col("mailbox").alias("c_mailbox"), F.unix_micros(F.col("created").cast("timestamp")).alias("at"), "thread_index")
    order = F.struct(F.coalesce(F.col("thread_index"), F.lit(-1)).alias("t"), "at", "chain_id")
    asked = messages.select("message_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "refs", F.nullif(F.lower(F.btrim(F.col("supplier_id").cast("string"))), F.lit("")).alias("supplier"), "mailbox")
    fits = F.col("mailbox").isNull() | F.col("c_mailbox").isNull() | (F.col("mailbox") == F.col("c_mailbox"))
    named = asked.select("message_id", "mailbox", F.explode(F.array_distinct("refs")).alias("chain_id")).join(open_.hint("merge"), "chain_id").where(fits)
    named = named.groupBy("message_id").agg(F.max(order).alias("named"))

    width = days * 86_400_000_000 // PARTS
    part = lambda c: F.floor(c / F.lit(width))
    none, every = F.lit("\0none"), F.lit("\0all")
    placed = open_.select(order.alias("o"), "at", part(F.col("at")).alias("part"), F.explode(F.array(F.coalesce("c_mailbox", none), every)).alias("box"), "c_supplier")
    placed = placed.select("o", "at", "part", "box", F.explode(F.filter(F.array("c_supplier", every), lambda x: x.isNotNull())).alias("who"))
    placed = placed.where("at is not null")
    whole = placed.groupBy("box", "who", "part").agg(F.max("o").alias("o"))
    between = whole.select("box", "who", F.explode(F.sequence(F.col("part") + 1, F.col("part") + (PARTS - 1))).alias("part"), "o").groupBy("box", "who", "part").agg(F.max("o").alias("o"))
    rows = asked.where("ts is not null and message_id is not null").withColumn("who", F.coalesce("supplier", every)).withColumn("box", F.explode(F.when(F.col("mailbox").isNull(), F.array(every)).otherwise(F.array(F.col("mailbox"), none))))
    since = F.col("ts") - PARTS * width
    looks = rows.select("box", "who", F.explode(F.array(F.struct(F.col("ts").alias("at"), F.lit(True).alias("up")), F.struct(since.alias("at"), F.lit(False).alias("up")))).alias("x"), "message_id").select("box", "who", part(F.col("x.at")).alias("part"), "x.at", "x.up", "message_id")
    run = placed.select("box", "who", "part", "at", "o").unionByName(between.withColumn("at", F.lit(-(2**63)))).unionByName(looks, allowMissingColumns=True)
    w = Window.partitionBy("box", "who", "part")
    until, later = (F.max("o").over(w.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)) for at in (F.col("at"), F.desc("at")))
    near = run.select("message_id", "up", until.alias("until"), later.alias("later")).where("message_id is not null")
    near = near.groupBy("message_id").agg(F.max(F.when(F.col("up"), F.col("until")).otherwise(F.col("later"))).alias("near"))
    out = asked.select("message_id", "supplier").join(named.hint("merge"), "message_id", "left").join(near.hint("merge"), "message_id", "left").where("named is not null or near is not null")
    via = F.when(F.col("named").isNotNull(), "message_id").otherwise("time_window")
    score = F.when(F.col("named").isNotNull(), 0.75).when(F.col("supplier").isNotNull(), 0.7).otherwise(0.6)
    return out.select("message_id", F.coalesce(F.col("named.chain_id"), F.col("near.chain_id")).alias("chain_id"), via.alias("via"), score.alias("score"))

