"""Assignment, interval joins, ratios, sentences and lines on small cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tenderloom.operators import labels, passages, threads

T0 = datetime(2024, 1, 1)
SENT = "workflow_id string, unique_id string, subject string, domain string, headers array<string>, ts timestamp"
GOT = "workflow_id string, response_id string, unique_id string, subject string, domain string, headers array<string>, ts timestamp"


def _messages(spark, seed=0, n=60):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    sent = [(f"w{i % 5}", f"d{i}", pick("a", "b", None), pick("x", "y", None), [f"<H{i}>"], T0 + timedelta(hours=i)) for i in range(n)]
    got = [(f"w{r.randrange(6)}", f"r{i:03}", pick(None, None, f"d{r.randrange(n)}"), pick("a", "b", None), pick("x", "y", "z"), [f"h{r.randrange(n)}"] if i % 4 == 0 else None, T0 + timedelta(hours=n + i * pick(1, 3))) for i in range(n)]
    return spark.createDataFrame(sent, SENT), spark.createDataFrame(got, GOT)


def test_assignment_rules(spark):
    day = lambda n: T0 + timedelta(days=n)
    sent = [("w", "d1", "a", "x", ["m1"], day(0)), ("w", "d2", "a", "x", ["m2"], day(0)), ("w", "d3", "b", "y", None, day(0)), ("v", "e1", None, "x", None, day(0)), ("u", "f1", None, "x", None, day(0)), (None, "g", None, None, None, day(0))]
    got = [
        ("w", "r1", None, "b", "y", [" <M2> "], day(1)),  # headers before everything else
        ("w", "r2", None, "a", "x", None, day(2)),  # d2 is taken
        ("w", "r3", "d1", None, None, None, day(3)),  # named, though taken
        ("w", "r4", None, "q", "y", None, day(20)),  # 0.3 + 0.25
        ("w", "r5", None, "a", "x", None, day(21)),  # none is left
        ("v", "s1", None, "q", "q", None, day(30)),  # the only one, nothing assigned yet
        ("u", "t1", None, "q", "q", None, day(1)),  # near in time
        ("x", "z1", None, "a", "x", None, day(1)),
    ]
    out = threads.assign_responses(spark.createDataFrame(sent, SENT), spark.createDataFrame(got, GOT)).collect()
    assert {r.response_id: (r.unique_id, r.score, r.how) for r in out} == {"r1": ("d2", 1.0, "score"), "r2": ("d1", 1.0, "score"), "r3": ("d1", 1.0, "unique-id"), "r4": ("d3", 0.55, "score"), "s1": ("e1", 0.55, "sole"), "t1": ("f1", 0.45, "score")}


def test_assignment_stream_equals_batch(spark, tmp_path):
    sent, got = _messages(spark)
    want = sorted(map(tuple, threads.assign_responses(sent, got).collect()))
    rows = threads.message_rows(sent, got)
    for i, part in enumerate([rows.where("sent"), rows.where("not sent and id < 'r020'"), rows.where("not sent and id >= 'r020'")]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in", mode="append") if i == 0 else part.coalesce(1).write.parquet(f"{tmp_path}/later{i}")
    # Responses come in order of arrival over two batches.
    order = sorted(r.ts for r in got.collect())
    middle = order[len(order) // 2]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s*")
    for name, part in (("s0", rows.where("sent")), ("s1", rows.where((~F.col("sent")) & (F.col("ts") < F.lit(middle)))), ("s2", rows.where((~F.col("sent")) & (F.col("ts") >= F.lit(middle))))):
        part.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        q = threads.assign_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    found = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("workflow_id", "response_id", "unique_id", "score", "how").collect()))
    assert found == want and len(want) > 20


def test_chains_of_the_ends_of_the_interval(spark):
    chain = "chain_id string, supplier_id string, mailbox string, thread_index int, created timestamp, awaiting boolean"
    message = "message_id string, ts timestamp, refs array<string>, supplier_id string, mailbox string"
    chains = [("old", "s", None, 1, T0, True), ("late", "s", None, 9, T0 + timedelta(days=5, microseconds=1), True), ("done", "s", None, 9, T0, False), ("box", "t", "b", None, T0, True), ("far", "t", None, 1, T0 - timedelta(days=400), True)]
    at = T0 + timedelta(days=5)
    messages = [("m1", at, None, " S ", None), ("m2", at, ["far"], "s", "q"), ("m3", at, [], "t", "other"), ("m4", at, [], "t", "b"), ("m5", at + timedelta(microseconds=1), [], None, None), ("m6", T0 + timedelta(days=40), [], None, None), ("m7", None, [], None, None)]
    got = threads.best_chains(spark.createDataFrame(messages, message), spark.createDataFrame(chains, chain)).collect()
    assert {r.message_id: (r.chain_id, r.via, r.score) for r in got} == {"m1": ("old", "time_window", 0.7), "m2": ("far", "message_id", 0.75), "m4": ("box", "time_window", 0.7), "m5": ("late", "time_window", 0.6)}
    plan = threads.best_chains(spark.createDataFrame(messages, message), spark.createDataFrame(chains, chain))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_chains_and_messages_are_one_sorted_run(spark):
    r = random.Random(5)
    at = lambda: T0 + timedelta(seconds=r.randrange(86400 * 9))
    chains = [(f"c{i:03d}", r.choice(["s", "t", None]), r.choice(["a", "b", None]), r.choice([1, 2, None]), at(), r.random() < 0.9) for i in range(300)]
    messages = [(f"m{i}", at() if i % 9 else chains[i][4] + timedelta(days=i % 2 * 5), [], r.choice(["S", "t", None]), r.choice(["a", "b", None])) for i in range(200)]
    want = {}
    for m, ts, _, supplier, box in messages:
        fit = [((-1 if c[3] is None else c[3]), c[4], c[0]) for c in chains if c[5] and ts - timedelta(days=5) <= c[4] <= ts and (not box or not c[2] or c[2] == box) and (not supplier or supplier.lower() == c[1])]
        if fit:
            want[m] = max(fit)[2]
    chain = "chain_id string, supplier_id string, mailbox string, thread_index int, created timestamp, awaiting boolean"
    message = "message_id string, ts timestamp, refs array<string>, supplier_id string, mailbox string"
    out = threads.best_chains(spark.createDataFrame(messages, message), spark.createDataFrame(chains, chain))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 3 and plan.count("Window [") == 2
    assert {x.message_id: x.chain_id for x in out.collect()} == want and len(want) > 100


def _typo(r, s):
    s = list(s)
    for _ in range(r.randint(0, 4)):
        i, c = r.randrange(len(s)) if s else 0, r.randint(0, 2)
        if c == 1:
            s.insert(i, r.choice("abcde "))
        elif s:
            s[i : i + 1] = [] if c == 0 else [r.choice("abcde")]
    return "".join(s)


def test_alike_equals_brute_force(spark):
    r = random.Random(1)
    terms = [" ".join(r.choice(["steel", "bolt", "nut", "brass", "wide", "long", "pin"]) for _ in range(r.randint(1, 4))) for _ in range(60)] + ["".join(r.choice("ab ") for _ in range(r.randint(1, 7))) for _ in range(60)]
    own = [_typo(r, x) for x in terms] + [None, "", "?!", "A-B"]
    norm = lambda s: " ".join("".join(c if c.isalnum() else " " for c in (s or "").lower()).split())

    def score(a, b):
        x, y = set(a.split(" ")), set(b.split(" "))
        return max(len(x & y) / len(x | y), SequenceMatcher(None, a, b, autojunk=False).ratio())

    for least in (0.7, 0.85, 1.0):
        want = {(a, b): score(norm(a), norm(b)) for a in set(own) for b in set(terms) if norm(a) and norm(b)}
        want = {k: v for k, v in want.items() if v >= least}
        got = labels.alike(spark.createDataFrame([(x,) for x in own], "label string"), spark.createDataFrame([(x,) for x in terms], "term string"), least).collect()
        assert {(x.label, x.term): x.score for x in got} == want and len(got) == len(want)


def test_labels_take_each_target_once(spark):
    terms = spark.createDataFrame([("due date", "due"), ("date due", "due"), ("issue date", "issued"), ("total", "total")], "term string, target string")
    records = spark.createDataFrame([(1, 1, "Due Date"), (1, 2, "Date due"), (1, 3, "Totals"), (1, 4, None), (2, 1, "x")], "record int, position int, label string")
    got = {(r.record, r.position): r.target for r in labels.assigned(records, terms).collect()}
    assert got == {(1, 1): "due", (1, 2): None, (1, 3): "total", (1, 4): None, (2, 1): None}
    assert labels.assigned(records.limit(0), terms).count() == 0


def test_sentences(spark):
    long = "Steel bolts are in stock at York. " * 20 + "We deliver steel bolts on Monday morning in boxes of ten and more. Nothing else is said about the price of wood."
    rows = [(1, long, "when are steel bolts delivered on monday"), (2, "Short. Text.", "x"), (3, None, "x"), (4, "", None), (5, "word " * 900, "word")]
    got = {r.k: r for r in passages.select_sentences(spark.createDataFrame(rows, "k int, text string, q string").withColumn("selection", F.lit("old")), "q").collect()}
    assert got[1].selection.startswith("Steel bolts are in stock at York. We deliver steel bolts on Monday") and len(got[1].selection) <= 0.7 * len(long)
    assert (got[2].selection, got[2].n_selected) == ("Short. Text.", 2)
    assert got[3].selection is None and got[3].n_selected is None and (got[4].selection, got[4].n_selected) == ("", 0)
    assert len(got[5].selection) == 1200 and got[5].n_selected == 1


def test_sentences_of_long_texts_cost_few_comparisons(monkeypatch):
    """Of the sentences that compete, only the best so far are compared with those chosen."""
    calls, likeness = [], passages.likeness
    monkeypatch.setattr(passages, "likeness", lambda a, b: calls.append(1) or likeness(a, b))
    text = " ".join(f"Bolt {i % 7} of lot {i} is here now." for i in range(400))
    found, n = passages.selected(text, "bolt lot 5", 1200)
    assert n > 20 and len(found) <= 1200 and len(calls) < n * passages.CONSIDERED / 2
    assert passages.sentences(" One!  Two \u2028") == ["One!", "Two \u2028"]  # as in SQL, a mark of a line's end is no end of the text


def test_lines(spark):
    text = "ANNUAL REPORT\n\nBuyer: Acme Ltd\n1 Scope of work\nWe deliver.  Soon\nIt goes on, and on.\r\n\nItem | Price\nTotal:\n"
    got = [tuple(r)[1:] for r in passages.line_kinds(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string"), "k").orderBy("line").collect()]
    assert got == [(1, "title", 1, None, None), (3, "key_value", 1, "Buyer", "Acme Ltd"), (4, "heading", 2, None, None), (5, "table", 2, None, None), (6, "paragraph", 2, None, None), (8, "table", 2, None, None), (9, "paragraph", 2, None, None)]
