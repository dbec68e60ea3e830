import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import common, components, language, leaks, licenses, near, private, quality, queries, repeats

from .fixtures import WORDS, documents, no_documents, prose, rows

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(texts, window):
    words = [SPLIT.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    want = Counter(zip([i for i, _ in rows()], brute_repeats([t for _, t in rows()], 35), strict=True))
    for group, most in ((2000, 1 << 20), (1, 1 << 20), (1, 0)):  # short prefixes, then long ones only: broadcast, joined
        monkeypatch.setattr(repeats, "GROUP", group)
        monkeypatch.setattr(repeats, "BROADCAST_ROWS", most)
        got = repeats.drop_repeats(documents(spark)).collect()
        assert Counter((r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in got) == want
    assert repeats.drop_repeats(no_documents(spark)).count() == 0


def test_subtrees_equal_counted_windows():
    """Random groups around one prefix, against counting every window."""
    r, window, anchor = random.Random(6), 9, 4
    prefix = [f"p{i}".encode() for i in range(anchor)]
    for _ in range(300):
        members = []
        for _ in range(r.randint(1, 7)):
            lead, first = r.randint(0, window - anchor), 0
            n = r.randint(1, lead + 1)
            words = [r.choice([b"a", b"b"]) for _ in range(lead)] + prefix
            words += [r.choice([b"a", b"b"]) for _ in range(n + window - 1 - len(words))]
            members.append((lead, n, b" ".join(words[first : n + window - 1])))
        seen = Counter((lead - k, *w.split()[k : k + window]) for lead, n, w in members for k in range(n))
        want = [[k for k in range(n) if seen[(lead - k, *w.split()[k : k + window])] > 1] for lead, n, w in members]
        assert repeats.deep_windows(members, window) == want


def test_maximal_repeats(spark):
    a, b = prose(1, 90), prose(2, 50)
    docs = spark.createDataFrame([(1, f"{prose(3, 20)} x {a} y {b} z"), (2, f"q {a} r"), (3, f"{b} s {prose(4, 40)}"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_words) for r in repeats.maximal_repeats(docs).collect())
    assert got == [(1, 21, 90), (1, 112, 50), (2, 1, 90), (3, 0, 50)]


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    label = {i: i for i in sets}
    names = sorted(sets)
    for _ in names:
        for a in names:
            for b in names:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in names}


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(near, "BLOCK", block)
    docs = [(i, t) for i, t in dict(rows()).items() if i is not None]
    r = random.Random(7)
    for g in range(6):  # chains: each differs from the one before in a word
        w = prose(100 + g, 60).split()
        for j in range(6):
            w[r.randrange(60)] = f"x{g}{j}"
            docs.append((1000 + 10 * g + j, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("n", F.lit("z"))
    got = near.near_duplicates(df, k=k).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(docs, k, 80)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_strays_make_no_pairs_of_all(spark, monkeypatch):
    """Loosely alike texts, some of them linked: all links are found, and few pairs are compared."""
    shared, r, docs = prose(50, 30).split(), random.Random(8), []
    for i in range(300):
        own = [f"u{i}x{j}" for j in range(45)]
        docs.append((i, " ".join(shared + own)))
        if i % 50 == 0:
            own[r.randrange(45)] = "z"
            docs.append((1000 + i, " ".join(shared + own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "candidate_groups", lambda nodes, percent: nodes.select("node", F.lit(0).cast("long").alias("component")))
    blocks, pairs, cut = [], [], near.cut

    def seen(table, name):
        out = cut(table, name)
        if name == "near-common":
            blocks.append(out.count())
        if name == "near-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near, "cut", seen)
    got = near.near_duplicates(df, k=2).collect()
    assert {x.doc_id: x.component_id for x in got if x.component_id != x.doc_id} == {1000 + i: i for i in range(0, 300, 50)}
    assert blocks == [0] and pairs[0] < 1000


def test_near_duplicates_of_odd_rows(spark):
    got = near.near_duplicates(documents(spark)).collect()
    assert len(got) == len(rows())
    assert all(x.kept and x.component_id is None for x in got if x.doc_id is None)
    assert near.near_duplicates(no_documents(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 3), (7, 7), (200, 201), (201, 200), (300, 300), (None, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(51), 100]} | {200: 200, 201: 200, 300: 300}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hubs_are_split(spark, monkeypatch):
    """The join at the hub of a star is a skewed join that Spark splits."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 40000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).union(spark.range(50000, 60000).select(F.col("id").alias("u"), (F.col("id") + 10000).alias("v")))
        monkeypatch.setattr(components, "small", lambda df: df)
        moved, _ = components._large_star(common.cut(edges, "edges"), 10**9, "star")
        moved.collect()
        assert "skew=true" in moved._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_leaks(spark):
    item = "A train leaves Boston at 60 km per hour and another leaves Denver at 45 km per hour, when do they meet on the long straight track?"
    other = item.replace("60", "80").replace("45", "35").replace("Boston", "Madrid").replace("Denver", "Lisbon")
    mixed = item.replace("at 60 km", "at 70 km")
    items = [(1, item), (2, "short one here"), (3, None), (4, ""), (None, "x y z")]
    texts = [(1, f"{prose(1, 30)} {item} {prose(2, 30)}"), (2, f"{prose(3, 30)}. {other} {prose(4, 9)}"), (3, prose(5, 200)), (4, None), (5, ""), (6, "see the short one here. Done"), (7, mixed), (None, item), (1, f"{prose(1, 30)} {item} {prose(2, 30)}")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("hash", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in leaks.leaks(docs, bench).collect()}
    assert got == {(1, 1): "exact", (2, 1): "re-parameterised", (7, 1): "re-parameterised", (6, 2): "exact"}
    assert {r.doc_id for r in leaks.decontaminate(docs, bench).collect()} == {3, 4, 5}  # the item without a doc_id goes, too
    assert leaks.leaks(docs.limit(0), bench).count() == 0 and leaks.leaks(docs, bench.limit(0)).count() == 0



def brute_leaks(docs, items, window=8, share=0.5):
    """The definition over strings, in loops over all windows."""
    token = re.compile(r"(?:[0-9A-Za-z\u0080-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+")
    low = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)

    def forms(text):
        out, runs, end = [], [], 0
        for m in token.finditer(text):
            w = m[0]
            number = w[0] in "0123456789"
            unit = bool(out) and not number and low(w) in leaks.UNITS and out[-1][0] == "<number>"
            capital = ("A" <= w[0] <= "Z" or "\u00c0" <= w[0] <= "\u00de") and len(w) > 1 and ("a" <= w[1] <= "z" or w[1] >= "\u00c0")
            begins = not out or any(c in ".!?\n\r:;|\"([" for c in text[end : m.start()])
            kind = "<number>" if number else "<name>" if capital and not begins else "<unit>" if unit else None
            out.append((kind or low(w), low(w) if kind else None, capital and begins, low(w)))
            runs.append((capital, begins))
            end = m.end()
        one = [(t, v, False) for t, v, _, _ in out]
        two = [("<name>", w, True) if o else (t, v, False) for t, v, o, w in out]
        three = []
        for (t, v, _, w), (capital, begins), k in zip(out, runs, range(len(out)), strict=True):
            if k and capital and runs[k - 1][0] and not begins:
                three[-1] = ("<name>", f"{three[-1][1]} {w}", three[-1][2])
            else:
                three.append(("<name>", w, begins) if capital else (t, v, False))
        return [(0, one, False), (0, two, True), (1, three, False)]

    def windows(text, sizes, whole):
        for form, t, opened_only in forms(text):
            for size in sizes:
                if whole and size < window and len(t) != size:
                    continue
                for i in range(len(t) - size + 1):
                    part = t[i : i + size]
                    opened = any(o for _, _, o in part)
                    if any(v is None for _, v, _ in part) and (opened or not opened_only):
                        yield form, i, tuple(k for k, _, _ in part), tuple(v for _, v, _ in part), opened

    lengths = {len(t) for _, x in items if x for _, t, _ in forms(x)}
    sizes = sorted({n for n in lengths if 0 < n < window} | {window})
    known, total = {}, {}
    for item, text in items:
        if item is not None and text:
            for form, i, kinds, values, opened in set(windows(text, sizes, True)):
                known.setdefault((form, kinds), set()).add((item, i, values, opened))
                total.setdefault((item, form), set()).add(i)
    found = {}
    for doc, text in docs:
        if doc is not None and text:
            for form, i, kinds, values, _ in windows(text, sizes, False):
                for item, k, own, opened in known.get((form, kinds), ()):
                    slots = sorted({(a, b) for a, b in zip(own, values, strict=True) if a is not None})
                    if not opened or len(kinds) >= window or sum(a is None for a in own) >= leaks.LITERALS or all(a == b for a, b in slots):
                        found.setdefault((doc, item, form, i - k), []).append((k, slots))
    scored = {}
    for (doc, item, form, _), rows in found.items():
        votes = Counter(s for _, slots in rows for s in slots)
        tie = {a: {b for (x, b), n in votes.items() if x == a and n == max(m for (y, _), m in votes.items() if y == a)} for a, _ in votes}
        if any(len(b) > 1 for b in tie.values()):
            scored.setdefault((doc, item, form), []).append(None)  # the operator breaks ties by hash
            continue
        for k, slots in rows:
            if all(tie[a] == {b} for a, b in slots):
                scored.setdefault((doc, item, form), []).append((k, all(a == b for a, b in slots)))
    out, unsure = {}, set()
    for (doc, item, form), rows in scored.items():
        if None in rows:
            unsure.add((doc, item))
            continue
        n = len(total[item, form])
        hit = len({k for k, _ in rows})
        if hit / n >= share:
            out.setdefault((doc, item), []).append((hit / n, all(same for _, same in rows), -form, n, hit))
    return {k: (max(v)[3], max(v)[4], "exact" if max(v)[1] else "re-parameterised") for k, v in out.items()}, unsure


def test_leaks_equal_brute_force(spark):
    r, names = random.Random(21), ["Alice", "Bob", "Carol", "Van Dyke", "Zoë", "Émile"]
    item = lambda a, b, n, m: f"{a} has {n} apples and {b} has {m} kg of pears. {a} gives {n} apples to {b}. How many apples does {a} have now?"
    items = [(1, item("Alice", "Bob", 12, 5)), (2, item("Émile", "Zoë", 3, 4).replace("apples", "plums")), (3, "Who wrote Hamlet"), (4, "short 12 km run"), (5, "Short Names Only"), (6, None), (7, ""), (None, "x y z"), (1, item("Alice", "Bob", 12, 5))]
    docs = []
    for i in range(60):
        a, b = r.sample(names, 2)
        text = item(a, b, r.randint(1, 99), r.randint(1, 9)).replace("apples", r.choice(["apples", "plums"]))
        if r.random() < 0.3:
            text = text.replace(a, r.choice(names), 1)
        own = r.choice([text, text[: len(text) // 2], items[r.randrange(5)][1], "they run short 15 km run daily", "so short 12 km run"])
        docs.append((i, r.choice(["", prose(i, 12) + ". ", prose(i, 12) + " "]) + own + r.choice(["", " " + prose(100 + i, 15)])))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, prose(7, 20000) + " " + items[0][1] + " " + items[0][1] + prose(8, 9)), (103, "A" * 5000), docs[0]]
    want, unsure = brute_leaks(list(dict.fromkeys(docs)), items)
    got = {(x.doc_id, x.item_id): (x.n_windows, x.n_matched, x.kind) for x in leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if k not in unsure} == {k: v for k, v in want.items() if k not in unsure}
    assert len(want) > 30 and len(unsure) < 15


def test_leaks_of_names_at_sentence_starts(spark):
    item = "Alice has 12 apples. Bob gives Alice 5 more apples. Alice then eats 3 of them. How many apples does Alice have now?"
    named = lambda a, b: item.replace("12", "17").replace("5", "8").replace("3", "4").replace("Alice", a).replace("Bob", b)
    items = [(1, item), (2, "Alice has 3 pears in town"), (3, "Who wrote Hamlet"), (4, named("Mary Ann", "Van Helsing").replace("apples", "plums"))]
    texts = [
        (1, f"{prose(1, 30)}. {named('Carol', 'Dave')} {prose(2, 30)}"),
        (2, f"{prose(3, 30)}. {named('Mary Ann Smith', 'Van Dyke')} {prose(4, 30)}"),
        (3, f"{prose(5, 30)} {item} {prose(6, 30)}"),
        (4, "they said Alice has 3 pears in town and left"),
        (5, "they say. Carol has 8 pears in town. They left"),
        (6, "he asked Who wrote Hamlet and left"),
        (7, "one day. Bob wrote Poems and left"),
        (8, named("Carol", "Dave").replace("Carol then", "Erin then").replace("does Carol", "does Frank").replace("gives Carol", "gives Gina")),
        (9, named("Zoe", "Tom").replace("apples", "plums")),
    ]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in leaks.leaks(docs, bench).collect()}
    new, exact = ("re-parameterised", 1.0), ("exact", 1.0)
    whole = {k: v for k, v in got.items() if v[1] == 1}
    assert whole == {(1, 1): new, (2, 1): new, (3, 1): exact, (4, 2): exact, (5, 2): new, (6, 3): exact, (9, 4): new}
    assert not any(d in (7, 8) for d, _ in got)


BASE = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(digits)))
            if (True, k == 1 and all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(digits) <= 19 and total % 10 == 0, 10 <= len(digits) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_brute_force():
    r = random.Random(11)
    for _ in range(20000):
        text = "".join(r.choice("a1.@-+ ()0é24") for _ in range(r.randint(0, 50)))
        assert private.base_spans(text) == brute_base(text), text


def test_private_data(spark):
    texts = [
        (1, "é mail a.b@c.de or +1 (415) 555-2671, card 4111 1111 1111 1111, host 10.0.0.1"),
        (2, "jane (at) corp.com, call (415) 555-2671, server 10[.]0[.]0[.]1"),
        (3, "order 1234567890123456 of 2024-01-05 10:22:33, total 12,345.67"),
        (4, None),
        (5, ""),
        (6, "1 " * 40000 + "a@" * 20000),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in private.find(df).collect()}
    whole = lambda kind, part: (kind, texts[0][1].index(part), texts[0][1].index(part) + len(part), True)
    assert got[1] == [whole("email", "a.b@c.de"), whole("phone", "+1 (415) 555-2671"), whole("card", "4111 1111 1111 1111"), whole("ip", "10.0.0.1")]
    assert [(k, b) for k, _, _, b in got[2]] == [("email", False), ("phone", False), ("ip", False)]
    assert not got[3] and not got[4] and not got[5]
    back = {r.doc_id: r.text for r in private.redact(df).collect()}
    assert back[1] == "é mail <EMAIL> or <PHONE>, card <CARD>, host <IP>" and back[2] == "<EMAIL>, call <PHONE>, server <IP>"
    assert back[3] == texts[2][1] and back[4] is None
    assert private.find(df.limit(0)).count() == 0


def test_private_data_in_texts_written_by_hand():
    """Forms that the generator of the snippets doesn't make, word for word."""
    model, local = private.train(), "x" * 70
    found = lambda text: [(k, text[a:b]) for k, a, b, _, _ in private.spans_of(text, model)]
    assert found(f"please write to {local} (at) example (dot) org today") == [("email", f"{local} (at) example (dot) org")]
    assert found("kontakt: jane dot doe at example dot com danke") == [("email", "jane dot doe at example dot com")]
    assert found("call 0171/2345678 0172/9876543 after six") == [("phone", "0171/2345678"), ("phone", "0172/9876543")]
    assert found("0171 555 1234 anrufen Telefon") == [("phone", "0171 555 1234")]
    assert found("my tel. is 0 1 7 1 - 5 5 5 - 1 2 3 4, ok?")[0][0] == "phone"
    for clean in (
        "On 2021-03-04 the invoice no. 20210304-17 over 1,250.00 EUR was paid.",
        "Chapter 12, pages 345-367, section 4.5.6 of version 10.2.33 of the code",
        "Scores 12 15 18 22 31 40 44 52 60 71 83 were counted in 1999, 2003 and 2010.",
        "We met at noon and dot the line; see you at home.",
        "Tracking number 00340434161094015902, order 4029357733",
    ):
        assert found(clean) == [], clean
    quads = "section 4.5.6.7 of version 10.2.33"  # four numbers are an ip by the base rule, whatever they mean
    assert [(k, quads[a:b], base) for k, a, b, base, _ in private.spans_of(quads, model)] == [("ip", "4.5.6.7", True)]


def test_private_candidates_on_new_examples():
    """Snippets of another seed: nearly all look-alikes stay, most data are found."""
    model, r = private.train(), random.Random(99)
    hits, data, exact, false, clean = 0, 0, 0, 0, 0
    for _ in range(2000):
        text, found = private._snippet(r)
        datum = found[0] if found else None
        spans = {(a, private.KINDS.index(k), b) for k, a, b, base, _ in private.spans_of(text, model) if not base}
        if datum:
            if private.base_spans(text):  # found without the trees
                continue
            data += 1
            hits += any(a < datum[2] and datum[0] < b for a, _, b in spans)
            exact += tuple(datum[:3]) in spans
        else:
            clean += 1
            false += bool(spans)
    assert exact / data >= 0.9 and hits / data >= 0.95 and false / clean < 0.02


def test_licences(spark):
    notice = licenses.TEMPLATES["Apache-2.0-notice"]
    texts = [(1, f"{prose(1, 20)}\n{notice}\n{prose(2, 9)}"), (2, notice.upper().replace(",", " ;")), (3, prose(4, 50)), (4, None), (5, ""), (6, "one"), (7, "Released under the MIT License."), (7, "Released under the MIT License."), (None, notice)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("n", F.lit(1))
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert got == {(1, "Apache-2.0-notice"), (2, "Apache-2.0-notice"), (7, "MIT")}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licences_inside_lines_and_over_lines(spark):
    notice = licenses.TEMPLATES["Apache-2.0-notice"].split()
    wrapped = "\n".join(" ".join(notice[i : i + 5]) for i in range(0, len(notice), 5))
    texts = [
        (1, "This module was written in 2019 by the core team. Released under the MIT License. See docs for more."),
        (2, f"{prose(1, 20)}\n{wrapped}\n{prose(2, 30)}"),
        (3, f"{prose(3, 9000)} released under the MIT license {prose(4, 40)} Licensed under CC BY-SA 4.0. {prose(5, 9)}"),
        (4, "Released under the MIT License.\nAnd this too: released under the old MIT License. So it is."),
        (5, "It was released under the sea, and MIT wrote the License later."),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.n_segments, r.dice) for r in licenses.scan(docs).collect()}
    assert got == {(1, "MIT"): (1, 1.0), (2, "Apache-2.0-notice"): (1, 1.0), (3, "MIT"): (1, 1.0), (3, "CC-BY-SA-4.0"): (1, 1.0), (4, "MIT"): (1, 1.0)}


def test_licences_by_standard_texts(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = "Copyright 2019 N. N.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    texts = [
        (1, gnu.format("")),
        (2, gnu.format("Affero ")),
        (3, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
        (5, bsd),
        (6, bsd + "\n3. Neither the name of N. N. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
        (7, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        (8, "Look: " + gnu.format("").replace(" under", "\nunder").replace("any", "\nany")),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {1: {"GPL-3.0"}, 2: {"AGPL-3.0"}, 3: {"CC-BY-NC-4.0"}, 4: {"MIT"}, 5: {"BSD-2-Clause"}, 6: {"BSD-3-Clause"}, 7: {"CC-BY-4.0"}, 8: {"GPL-3.0"}}


def test_language(spark):
    r = random.Random(3)
    letters = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "абвгдежз"}
    make = lambda lang, n=40: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))
    texts = [(i, make(lang), lang) for i, lang in enumerate([*letters] * 40)]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 !?", "bb"), (1003, make("cc", 30000), None), (None, make("bb"), None)]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.train(docs.where("doc_id is null or doc_id % 4 <> 2"))
    got = {x.doc_id: x for x in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 and not got[i].rejected for i, _, lang in texts)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "cc", "bb"]
    nothing = language.train(docs.limit(0))
    assert {x.lang_pred for x in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def brute_kneser_ney(texts, order=4, d=0.75):
    """log p of every predicted character by dictionaries of counts, in the definition's recursion."""
    clean = [re.sub(r"[^a-zа-я]+", " ", t.lower()) for t in texts]
    top = Counter()
    for t in clean:
        s = " " * (order - 1) + t  # a text begins after gaps
        top.update(s[i : i + order] for i in range(len(t)))
    tables = [top]
    for _ in range(order - 1):
        tables.append(Counter(g[1:] for g in tables[-1]))  # in how many distinct n-grams

    heads = [{} for _ in tables]
    for table, own in zip(tables, heads, strict=True):
        for g, n in table.items():
            total, kinds = own.get(g[:-1], (0, 0))
            own[g[:-1]] = total + n, kinds + 1

    def p(gram, level=0):
        if level == order:
            return 1 / 256
        total, kinds = heads[level].get(gram[:-1], (0, 0))
        rest = p(gram[1:], level + 1)
        if not total:
            return rest
        return max(tables[level][gram] - d, 0) / total + d * kinds / total * rest

    return p


def test_kneser_ney_equals_brute_force(spark):
    import math

    r = random.Random(12)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))
    train = [(i, make("abcde", 30), "aa") for i in range(20)] + [(100 + i, make("cdefжз", 30), "bb") for i in range(20)]
    new = ["abc dea cab", "жз fed", "xyz abc", "e"]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    models = {lang: brute_kneser_ney([t for _, t, x in train if x == lang]) for lang in ("aa", "bb")}
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*new, new[0], None, ""])], "doc_id long, text string")
    rows = []
    for cells in (language.CELLS, 200):  # one slice; many
        model = language.train(docs, cells=cells)
        assert (len(model.tops) > 1) == (cells == 200)
        e, _ = model.entropies(new)
        for k, lang in enumerate(("aa", "bb")):
            for t, got in zip(new, e[:, k], strict=True):
                padded = "   " + t
                want = -sum(math.log(models[lang](padded[i : i + 4])) for i in range(len(t))) / len(t)
                assert abs(got - want) < 1e-5 * want, (lang, t, got, want)
        rows.append({x.doc_id: (x.lang_pred, round(x.score, 6), x.rejected) for x in language.identify(texts, model).collect()})
    assert rows[0] == rows[1] and len(rows[0]) == 7


def test_probabilities_sum_to_one():
    import numpy as np

    code, _, _ = language.codes(["the cat sat on the mat", "a hat and a cat"])
    keys, counts = np.unique(code, return_counts=True)
    model = language.build({"en": (keys.astype(np.uint32), counts)})
    for context in ("the", "cat", "xqz", "at "):
        head = language.codes([context + "a"])[0][-1] & np.uint32(0xFFFFFF00)
        every = (head | np.arange(256, dtype=np.uint32)).astype(np.uint32)
        assert abs(np.exp(model.log(every)).sum() - 1) < 1e-3


def test_ftrl_equals_brute_force():
    """The updates by dictionaries of numbers."""
    import math

    import numpy as np

    r, z, n, bias, seen = random.Random(5), Counter(), Counter(), 0.0, 0.0
    model = quality.Ftrl(6)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(300):
        slots, y = sorted(r.sample(range(64), r.randint(0, 9))), r.randint(0, 1)
        model.update(np.array(slots, np.int64), y)
        x = 1 / math.sqrt(max(len(slots), 1))
        w = {i: weight(i) for i in slots}
        g = 1 / (1 + math.exp(-(bias + sum(w.values()) * x))) - y
        seen += g * g
        bias -= 0.5 * g / (1 + math.sqrt(seen))
        for i in slots:
            z[i] += g * x - (math.sqrt(n[i] + (g * x) ** 2) - math.sqrt(n[i])) / quality.ALPHA * w[i]
            n[i] += (g * x) ** 2
    assert np.allclose(model.weights(np.arange(64)), [weight(i) for i in range(64)]) and abs(model.bias - bias) < 1e-9


def test_quality_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 50 + [(1, "other text"), (2, "bad words there")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = docs.dropDuplicates().collect()
    once = min((r for r in rows if r.doc_id == 1), key=lambda r: docs.sparkSession.createDataFrame([(r.text,)], "t string").select(F.xxhash64("t")).first()[0])
    alone = spark.createDataFrame([(1, once.text), (2, "bad words there")], "doc_id long, text string")
    for got, want in zip(quality.train(docs, labels), quality.train(alone, labels), strict=True):
        assert (got == want).all() if hasattr(got, "all") else got == want


def test_quality(spark):
    r = random.Random(4)
    good, bad = WORDS[:40], WORDS[20:]
    texts = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(50))) for i in range(300)]
    docs = spark.createDataFrame(texts + [(900, None), (901, ""), (None, "w1 w2"), (902, "w1 " * 30000)], "doc_id long, text string").withColumn("label", F.lit(7)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(250, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {x.doc_id: x for x in quality.score(docs, model).collect()}
    assert sum(got[i].predicted == i % 2 for i in range(200, 300)) >= 95
    assert got[900].score == got[901].score and all(0 <= x.score <= 1 for x in got.values())
    assert {x.score for x in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_queries_equal_their_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{d}/{name}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        want, got = con.sql(sql), queries.QUERIES[name](spark, d)
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        assert Counter(want.select(", ".join(columns)).fetchall()) == Counter(map(tuple, got.select(columns).collect())), name
