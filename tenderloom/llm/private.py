"""Personal data: base rules, and candidates that gradient-boosted trees select.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and
non-overlapping for each kind, and always stay. High-recall generators propose
further, overlapping spans of the same kinds: written-out or spaced addresses,
masked and version-6 IPs, digit chains with other separators. Boosted trees
judge the format of each candidate and its context; a candidate is taken if its
probability reaches the threshold of its kind and it overlaps neither a base
span nor a likelier candidate.

The trees are fitted on EXAMPLES made-up snippets from a seeded generator (forms
of personal data, and look-alikes: dates, orders, prices, versions, failing card
numbers), so no corpus text and no label is used. Part of the snippets is held
back; each threshold is the lowest at which the held-back precision is at least
PRECISION if there are LOOKALIKES times as many look-alikes as in the snippets.
A kind that doesn't reach it is an error.

Every scan is linear in the text: addresses are extended from their sign,
digit runs are matched whole. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.boosting import Trees, fit
from tenderloom.llm.common import give_back

KINDS = ("email", "ip", "card", "phone")
#: Made-up snippets that the fit uses.
EXAMPLES = 6000
PRECISION = 0.9
LOOKALIKES = 10

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at + 1)
        if found:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = found.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base spans, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_SIGN = re.compile(r"[@\[({<](?:(?<=@)|(?<!@) ?[aA][tT] ?[\])}>])")
_WORD_SIGN = re.compile(r" at (?=[A-Za-z0-9-]++ dot [A-Za-z])", re.I)
_DOT_BEFORE = re.compile(r"(?: dot | ?[\[({<] ?dot ?[\])}>] ?)\Z", re.I)
_AFTER_SIGN = re.compile(r" ?[A-Za-z0-9-]++(?:(?: ?\. ?| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot )[A-Za-z0-9-]++)++", re.I)
_MASKED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:[\[({](?:\.|dot)[\])}]|\.) ?[0-9]{1,3}+){3}(?![0-9])", re.I)
_COLONS = re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:")
_SIX = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{1,4}:)[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:])")
_CHAIN = re.compile(r"[0-9](?:[ ()./_-]{0,3}+[0-9])++")
_LEAD = re.compile(r"(?:\+ ?\(?|\()\Z")
_GROUP = re.compile(r"(?:\+ ?)?\(?[0-9]+\)?")


def _local_start(text: str, at: int, floor: int) -> int:
    """Where the local part before a sign at `at` begins, not before floor; its
    dots may be written out. `at` itself if there is none."""
    end, start = at - (at > floor and text[at - 1] == " "), at
    while True:
        a = end
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        if a == end:
            return start
        start = a
        dot = _DOT_BEFORE.search(text[max(floor, a - 8) : a])
        if not dot:
            return start
        end = a - len(dot[0])


def candidates(text: str) -> set[tuple[int, int, int]]:
    """(start, kind, end) of every proposal, base-like ones too."""
    out: set[tuple[int, int, int]] = set()
    signs = list(_SIGN.finditer(text))
    if " dot " in text or " DOT " in text:
        signs = sorted([*signs, *_WORD_SIGN.finditer(text)], key=lambda m: m.start())
    floor = 0
    for m in signs:
        right = _AFTER_SIGN.match(text, m.end()) or (_AFTER_SIGN.match(text, m.end() - 1) if m[0].endswith(" ") else None)
        start = _local_start(text, m.start(), floor) if right else m.start()
        if start < m.start():
            out.add((start, 0, right.end()))
        floor = m.end()  # so the local parts are scanned once in all
    out.update((m.start(), 1, m.end()) for m in _MASKED_IP.finditer(text))
    if _COLONS.search(text):
        out.update((m.start(), 1, m.end()) for m in _SIX.finditer(text))
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        lead = _LEAD.search(text[max(0, m.start() - 3) : m.start()])
        first = m.start() - (len(lead[0]) if lead else 0)
        parts = [(first + g.start(), first + g.end()) for g in _GROUP.finditer(text[first : m.end()])]
        digits = ["".join(_DIGITS.findall(text[a:b])) for a, b in parts]
        for i, (a, _) in enumerate(parts):  # every run of 7 to 19 digits: few for each start
            own = ""
            for (_, b), more in zip(parts[i:], digits[i:], strict=True):
                own += more
                if len(own) > 19:
                    break
                if len(own) >= 13 and luhn(own):
                    out.add((a, 2, b))
                if 7 <= len(own) <= 15:
                    out.add((a, 3, b))
    return out


_CUES = [
    re.compile(p)
    for p in (
        r"\be-?mail|\bcontact|\bwrite|\breach|\bmailto|\bcorreo|\bcourriel",
        r"\bip\b|\bhost|\bserver|\bping|\baddress|\blogin from|\bclient",
        r"\bcards?\b|\bvisa\b|\bmaster ?card|\bamex|\bcredit|\bdebit|\bpayment|\btarjeta|\bcarte\b|\bkarte\b",
        r"\bphone|\btel\b|\btel[.:]|\bcall\b|\bcall:|\bfax\b|\bmobile|\bcell\b|\bwhatsapp|\bsms\b|\btelefon|\bhandy|\bmovil|\banrufen|\bmy number",
        r"\border|\binvoice|\bref\b|\bno\.|\btracking|\bisbn|\bserial|\bid\b|\bsku|\bbatch|\bcase\b|\bversion|\bv\b|\bpage|\bcode",
        r"\bprice|\btotal|\bsum\b|\bamount|\busd|\beur\b|[$€£]|\bdate|\bsince|\bfrom 1|\bfrom 2|\bscore|\bsection",
    )
]


_ALNUM = re.compile(r"[^\W_]+")
_DIGIT_NEAR = re.compile(r"[0-9][ .,/-]?$")
_DIGIT_NEXT = re.compile(r"[ .,/-]?[0-9]")
#: Common top-level domains, fixed values.
_DOMAINS = frozenset("com org net edu gov mil int info biz example test local io ai co app dev eu de fr uk us es it nl be at ch pl se no dk fi pt ru jp cn in br ca au".split())


def _cues(context: str) -> tuple[float, ...]:
    return tuple(float(bool(c.search(context))) for c in _CUES)


def _before(text: str, a: int) -> tuple[float, ...]:
    before = text[max(0, a - 32) : a].lower()
    return float(before[-1:].isalnum()), float(before[-1:] in tuple("$€£#/=.,-_:")) if before else 0.0, float(bool(_DIGIT_NEAR.search(before))), *_cues(before)


def _after(text: str, b: int) -> tuple[float, ...]:
    after = text[b : b + 24].lower()
    return float(after[:1].isalnum()), float(after[:1] in tuple("%-/.,:")) if after else 0.0, float(bool(_DIGIT_NEXT.match(after))), *_cues(after)


def _format(s: str, kind: int) -> tuple[float, ...]:
    runs = _DIGITS.findall(s)
    sizes = [len(r) for r in runs] or [0]
    digits = "".join(runs)
    seps = _ALNUM.sub("", s)
    last, low = s.rsplit(".", 1)[-1].rsplit(" ", 1)[-1], s.lower()
    return (
        *(float(kind == k) for k in range(4)), len(s), len(digits), len(s) - len(seps) - len(digits), len(seps), s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count(":"), s.count("("), s.count("_"),
        len(runs), max(sizes), min(sizes), sizes[0], sizes[-1], sizes.count(4), len(set(digits)), float(len(digits) >= 13 and luhn(digits)),
        float(s[0] == "+"), float(s[:2] == "00"), float(s[0] == "0"), int(digits[0]) if digits else -1, float(all(int(r[:4]) <= 255 for r in runs)), float(sizes[0] == 4 and 1900 <= int(runs[0]) <= 2100),
        len(set(seps)), float("@" in s), float("at" in low), float("dot" in low), float(last.isalpha()), len(last), float("::" in s), float(last.lower() in _DOMAINS),
    )


def features(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Format and context of candidates; a context is read once for each edge."""
    left = {a: _before(text, a) for a in {a for a, _, _ in spans}}
    right = {b: _after(text, b) for b in {b for _, _, b in spans}}
    return np.array([(*_format(text[a:b], kind), *left[a], *right[b]) for a, kind, b in spans], float)


def _snippet(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up text and its personal data, none or one or, of phones, two."""
    word = lambda: "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(1, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    pick = r.choice
    kind = pick([0, 1, 2, 3, None, None, None, None])
    cue = ""
    if kind == 0:
        a, d, t = pick([word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}.{num(2)}"]), pick([word(), f"{word()}{num(1)}.{word()}", "mail.example"]), pick(["com", "org", "net", "de", "fr", "io"])
        sign, dot = pick([(" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot "), (" @ ", "."), (" @ ", " . "), ("@", " [dot] "), (" at ", " dot ")])
        if dot.strip(" ([])") == "dot" and r.random() < 0.4:
            a = a.replace(".", dot) if "." in a else f"{a}{dot}{word()}"
        s, cue = f"{a}{sign}{d.replace('.', dot)}{dot}{t}", pick(["email ", "contact: ", "write to ", "reach me: ", "mail ", ""])
    elif kind == 1:
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        s = pick([pick(["[.]", "(.)", "[dot]", " . "]).join(parts), ":".join(f"{r.randint(0, 65535):x}" for _ in range(8)), f"{r.randint(4096, 65535):x}:{r.randint(256, 65535):x}::{r.randint(1, 65535):x}"])
        cue = pick(["ip ", "host ", "server: ", "client address ", "ping ", ""])
    elif kind == 2:
        body = pick(["4", "5", "37", "6"])
        body += num(pick([13, 15, 15, 15, 15, 14, 18]) - len(body) - (body == "37"))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick([".", "/", "  ", " - ", "_", ". "])[:2]
        s, cue = sep.join(body[i : i + 4] for i in range(0, len(body), 4)), pick(["card ", "visa ", "credit card: ", "payment with ", ""])
    elif kind == 3:
        s = pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"00{num(2)} {num(3)} {num(7)}", f"+{num(2)}/{num(3)}/{num(6)}", f"+ {num(1)} {num(3)} {num(3)} {num(4)}", f"0{num(3)}/{num(7)}", f"{num(3)} {num(3)} {num(4)}"])
        cue = pick(["phone ", "tel. ", "call ", "fax: ", "mobile ", "whatsapp ", "phone: "]) if not s.startswith(("(", "+")) else pick(["phone ", "call ", "", "tel: "])
    else:
        y, mo, d = str(r.randint(1900, 2050)), f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}"
        wrong = num(pick([13, 14, 15, 16, 16, 16, 16, 19]))
        while luhn(wrong):
            wrong = num(len(wrong))
        s = pick(
            [
                f"{y}-{mo}-{d}", f"{d}/{mo}/{y}", f"{d}.{mo}.{y}", f"{y}-{mo}-{d} {num(2)}:{num(2)}:{num(2)}", f"{y}/{mo}/{d} - {y}/{mo}/{d}", f"{num(2)}:{num(2)}:{num(2)}", wrong, wrong, " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), "-".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)),
                f"{num(1)}.{num(1)}.{num(2)}", f"{num(2)}.{num(3)}.{num(3)},{num(2)}", f"{num(3)} {num(3)} {num(3)}", " ".join(num(r.randint(1, 4)) for _ in range(r.randint(3, 7))), f"{y} {r.randint(1900, 2050)} {r.randint(1900, 2050)} {r.randint(1900, 2050)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)}-{num(2)}-{num(4)}",
                num(r.randint(7, 12)), num(r.randint(7, 12)), f"{num(5)}-{num(6)}", ":".join(f"{r.randint(0, 255):02x}" for _ in range(6)), f"{word()} at {word()} dot {word()} {word()}", f"{word()} (at) {word()}", f"{word()} @ {num(2)}.{num(2)}", f"{num(2)}.{num(1)}.{num(3)} . {num(4)}", f"{num(1)}.{num(5)} {num(1)}.{num(5)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}",
            ]
        )
        cue = pick(["order ", "invoice no. ", "total ", "isbn ", "since ", "version ", "tracking ", "ref ", "$", "section ", "id ", "date ", "score ", "", "", ""])
    tail = pick(["", "", "", *_TAILS[kind]]) if kind is not None else pick(["", "", *_TAILS[None]])
    if kind is not None and tail and r.random() < 0.5:
        cue = ""
    second = ""
    if kind == 3 and not s.startswith("+") and r.random() < 0.25:
        second = "".join(c if not c.isdigit() or i < 2 else pick("0123456789") for i, c in enumerate(s))
    lead = some(r.randint(0, 5))
    head = f"{lead} {cue}" if lead and r.random() < 0.9 else f"{some(2)} {cue}" if not cue else cue
    text = f"{head}{s}{' ' + second if second else ''}{tail or pick(['', '.', ',', ' ', ''])} {some(r.randint(0, 5))}"
    data = [(len(head), kind, len(head) + len(s))] if kind is not None else []
    return text, [*data, (len(head) + len(s) + 1, kind, len(head) + len(s) + 1 + len(second))] if second else data


#: What may follow a datum of a kind, and a look-alike.
_TAILS: dict[int | None, list[str]] = {
    0: [" is my email", " mail me"],
    1: [" is the server", " host"],
    2: [" visa", " is my card"],
    3: [" telefon", " anrufen telefon", " (mobile)", " is my number", " call me", " anrufen"],
    None: [" items", " eur", " pages", " order", " usd total", " units"],
}


@dataclass
class Model:
    trees: Trees
    thresholds: tuple[float, ...]


@lru_cache
def train(examples: int = EXAMPLES, precision: float = PRECISION, seed: int = 5) -> Model:
    """Deterministic; a few kilobytes."""
    r = random.Random(seed)
    x, y, held, kinds = [], [], [], []
    for i in range(examples):
        text, data = _snippet(r)
        base = base_spans(text)
        for c in sorted(candidates(text)):
            if any(c[0] < b and a < c[2] for a, _, b in base):
                continue
            if c not in data and any(d[0] <= c[0] and c[2] <= d[2] and c[1] == d[1] for d in data):
                continue  # part of a datum is neither
            x.append(features(text, [c])[0])
            y.append(c in data)
            held.append(i % 3 == 2)
            kinds.append(c[1])
    x, y, held, kinds = np.array(x, float), np.array(y, float), np.array(held), np.array(kinds)
    trees = fit(x[~held], y[~held])
    p = trees.probabilities(x[held])
    thresholds = []
    for k in range(len(KINDS)):
        own, right = p[kinds[held] == k], y[held][kinds[held] == k]
        order = np.argsort(-own, kind="stable")
        good, bad = np.cumsum(right[order]), np.cumsum(1 - right[order])
        ok = np.flatnonzero(good >= precision * (good + LOOKALIKES * bad))
        if not len(ok) or not good[ok[-1]]:
            raise ValueError(f"no threshold of {KINDS[k]} reaches the precision {precision}")
        thresholds.append(float(own[order][ok[-1]]))
    return Model(trees, tuple(thresholds))


def spans_of(text: str | None, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """kind, start, end, base, score of a text's spans, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    found = [(a, k, b, True, 1.0) for a, k, b in base]
    rest = sorted(candidates(text))
    if rest:
        reach, at = [], 0  # latest end of the base spans so far
        for _, _, b in base:
            at = max(at, b)
            reach.append(at)
        starts = np.array([a for a, _, _ in base], np.int64)
        free = []
        for c in rest:
            k = int(np.searchsorted(starts, c[2])) - 1  # base spans that begin before its end
            if k < 0 or reach[k] <= c[0]:
                free.append(c)
        if free:
            p = model.trees.probabilities(features(text, free))
            likely = [(-round(float(q), 9), c[0] - c[2], c) for q, c in zip(p, free, strict=True) if q >= model.thresholds[c[1]]]
            taken: list[tuple[int, int, int]] = []
            edges: list[int] = []
            for q, _, c in sorted(likely):
                k = bisect_right(edges, c[0])
                # edges alternates start, end of what is taken: an odd place lies inside
                if k % 2 or (k < len(edges) and edges[k] < c[2]):
                    continue
                insort(edges, c[0])
                edges.insert(bisect_right(edges, c[0]), c[2])
                taken.append(c)
                found.append((*c, False, -q))
    return [(KINDS[k], a, b, is_base, q) for a, k, b, is_base, q in sorted(found)]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def find(docs: DataFrame, model: Model | None = None, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with `spans`, by start, then kind; a null or empty text has none.
    A column of that name is replaced; other columns are carried along, rows are
    independent of each other, an empty table gives an empty one."""
    model = model or train()
    keep = [c for c in docs.columns if c != spans]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(spans, T._parse_datatype_string(SPANS))])
    at, kind = keep.index(text), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in spans_of(x, model)] for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], schema.names)
            give_back()

    return docs.select(*keep).mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in capitals in
    angle brackets; overlapping spans are replaced together, by the first one's
    kind. A null text stays null, a text without spans stays as it is."""
    model = model or train()
    at, schema = docs.columns.index(text), docs.schema

    def one(x: str | None) -> str | None:
        spans = spans_of(x, model)
        if not spans:
            return x
        out, done, last = [], 0, None
        for kind, a, b, _, _ in spans:
            if last is not None and a < done:
                done = max(done, b)
                continue
            out += [x[done:a], f"<{kind.upper()}>"]
            done, last = b, kind
        return "".join([*out, x[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([one(x) for x in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)
            give_back()

    return docs.mapInArrow(run, schema)
