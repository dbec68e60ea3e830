"""Expressions that find the fields of invoices and orders in their texts, judge
found values, and score offers. Built-in expressions only; a null text has no
fields."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = "[£$€¥₹]"
_AMOUNT = r"\d[\d,]*(?:\.\d+)?"
MONEY, MAYBE_MONEY = rf"({SIGN}\s*{_AMOUNT})", rf"({SIGN}?\s*{_AMOUNT})"
#: A number with letters, slashes and hyphens in it, three characters at least, and one that begins with a digit.
TOKEN, DIGITS = r"((?:[A-Z]+[/-]?)*\d[A-Z0-9/-]{1,20})", r"(\d[A-Z0-9/-]{2,20})"


def either(words: Sequence[str]) -> str:
    """Any of the words, whole: blanks in them may be any or none, dots may be left out."""
    parts = [w.replace(".", r"\.?").replace(" ", r"[\s-]*") for w in words]
    return rf"(?:{'|'.join(rf'\b{x}' if x[0].isalnum() else x for x in parts)})"


def ahead(words: Sequence[str]) -> str:
    """Only where one of the words can begin: one look instead of one for each word."""
    return f"(?=[{''.join(sorted({w[0].lower() for w in words}))}])"


def after(labels: Sequence[str], value: str, between: str = r"[\s.:]*") -> str:
    """The value behind one of the labels."""
    return rf"(?i){ahead(labels)}{either(labels)}{between}{value}"


def numbered(names: Sequence[str], token: str = TOKEN) -> str:
    """The number behind a name, with or without a word for number."""
    return after(names, rf"(?:{either(NUMBER_WORDS)})?[\s.:#-]*{token}", r"[\s.-]*")


def alone(token: str) -> str:
    """The token on a line of its own."""
    return rf"(?i)(?:^|\n)[ \t]*{token}[ \t]*(?:\n|$)"


# Words that announce a field, and what they stand for.
NUMBER_WORDS = ("number", "num", "no", "reference", "ref", "#")
ORDER_NAMES, TAX_WORDS = ("purchase order", "p.o."), ("sales tax", "tax", "vat", "gst")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
SIGN_CODES = {"£": "GBP", "$": "USD", "€": "EUR", "¥": "JPY", "₹": "INR"}
CODES = ("GBP", "USD", "EUR", "JPY", "INR")
PRODUCT_WORDS = {
    "it hardware": ("laptop", "desktop", "notebook", "printer", "server", "monitor", "keyboard", "mouse"),
    "it software": ("software", "license", "subscription", "saas"),
    "office supplies": ("paper", "pen", "stapler", "notebook", "folder"),
}
RECORD_NAMES = {"Invoice": ("invoice",), "Purchase_Order": ORDER_NAMES, "Quote": ("quote",), "Contract": ("contract",)}
COMPANY_FORMS = ("ltd", "limited", "llc", "inc", "incorporated", "corp", "corporation", "plc", "gmbh", "pvt", "private", "co", "company", "sa", "srl", "ag", "pty")
INNOVATION_WORDS = ("innovation", "roadmap", "co develop", "automation", "analytics", "ai", "machine learning")
DISCOUNT_WORDS = ("discount", "reduce", "reduction", "drop", "saving", "concession", "better price")

#: Of several patterns the first that matches counts.
INVOICE_NUMBER = (numbered(("invoice", "inv.", "bill")), alone(r"(inv[/-]?[A-Z0-9/-]*\d[A-Z0-9/-]*)"))
ORDER_NUMBER = (numbered(ORDER_NAMES, rf"(?:PO[\s-]*)?{DIGITS}"), rf"(?i)(?:^|\n)[ \t]*{DIGITS}[ \t]*\n\s*{either(ORDER_NAMES)}", alone(rf"PO[\s-]*{DIGITS}"))
_DAY, _MONTH, _YEAR = r"\d{1,2}(?:st|nd|rd|th)?", f"{ahead(MONTHS)}(?:{'|'.join(m[:3] for m in MONTHS)})[a-z]*", r"\d{4}"
_NUMERIC = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
_FORMS = ([_NUMERIC], [_MONTH, _DAY, _YEAR], [_DAY, _MONTH, _YEAR], [r"\d{4}-\d{2}-\d{2}"], [_MONTH, _YEAR])
DATES = tuple(rf"(?i)\b({r'[\s.,]+'.join(parts)})\b" for parts in _FORMS)
#: The stretch behind a label in which a date is looked for.
_STRETCH = r"([\s\S]{0,120})"
INVOICE_DATE = (after(("invoice date", "date of invoice", "date issued", "issue date", "issued on"), _STRETCH), after(("date",), f"({_NUMERIC})"))
DUE_DATE = (after(("due date", "date due", "payment due", "pay by"), _STRETCH),)
ORDER_DATE = (after(("order date", "p.o. date", "date of order"), _STRETCH),)
TOTAL = (rf"(?i)(?:^|\n)\s*total[\s:]+{MONEY}", after(("grand total", "total amount", "total due", "total payable", "amount due", "balance due"), MAYBE_MONEY))
SUBTOTAL = (after(("sub total", "net amount", "net total"), MAYBE_MONEY),)
AFTER_SUBTOTAL, LINE_OF_MONEY = rf"(?i){ahead('s')}{either(['sub total'])}[ \t]*\n([\s\S]*)", rf"(?m)^\s*{MONEY}"
#: On the label's line; or the second of two amounts under two labels.
TAX = (after(TAX_WORDS, MONEY, r"[ \t]*(?:\([\d.]+ ?%\))?[ \t:]*"), rf"(?i){ahead('s')}{either(['sub total'])}[ \t]*\n[ \t]*{either(TAX_WORDS)}[^\n]*\n[ \t]*{SIGN}[^\n]*\n[ \t]*{MONEY}")
TERMS = (after(("terms", "term"), r"(\d+)\s*days"), after(("within", "due in"), r"(\d+)\s+days", r"\s+"), after(("net",), r"(\d+)\b", r"\s+"))
AT_ONCE = after(("payment", "payable"), either(("immediately", "upon receipt")), r"[^.\n]{1,40}")
RECORD_ID = {kind: numbered(names, r"((?:[A-Z]+[/-]?)*\d[A-Z0-9/-]*)") for kind, names in RECORD_NAMES.items()}
COMPANY_WORDS = rf"(?i){either(COMPANY_FORMS)}\b"
INNOVATION, DISCOUNT = f"(?i)({either(INNOVATION_WORDS)})", f"(?i)({either(DISCOUNT_WORDS)})"
SCORE_WEIGHTS = {"price": 0.32, "terms": 0.22, "response": 0.18, "risk": 0.18, "green": 0.10}


def first_of(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, trimmed; else null."""
    return F.coalesce(*[F.nullif(F.btrim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def invoice_number(text: Column) -> Column:
    return first_of(text, INVOICE_NUMBER)


def order_number(text: Column) -> Column:
    return first_of(text, ORDER_NUMBER)


def date_after(text: Column, labels: Sequence[str]) -> Column:
    """The first date, in the order of the date patterns, behind the first label
    that has one."""
    return F.coalesce(*[first_of(F.regexp_extract(text, label, 1), DATES) for label in labels])


def every_date(text: Column) -> Column:
    """All dates without repetitions, pattern by pattern; none for a null."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in DATES])
    return F.array_distinct(found)


def currency_of(text: Column) -> Column:
    """The code of the first amount's sign, else the first of the codes in the text."""
    by_sign = F.try_element_at(F.create_map(*[F.lit(x) for kv in SIGN_CODES.items() for x in kv]), F.regexp_extract(text, rf"({SIGN})\s*[\d,]+", 1))
    by_code = F.when(F.lit(False), "")
    for code in CODES:
        by_code = by_code.when(F.upper(text).contains(code), code)
    return F.coalesce(by_sign, by_code)


def total_of(text: Column) -> Column:
    return first_of(text, TOTAL)


def subtotal_of(text: Column) -> Column:
    """The amount behind a subtotal, or the first line after it that opens with money."""
    return F.coalesce(first_of(text, SUBTOTAL), first_of(F.regexp_extract(text, AFTER_SUBTOTAL, 1), [LINE_OF_MONEY]))


def tax_of(text: Column) -> Column:
    return first_of(text, TAX)


def terms_of(text: Column) -> Column:
    """Days of the payment terms as text, 0 for payment at once."""
    return F.coalesce(first_of(text, TERMS), F.when(text.rlike(AT_ONCE), "0"))


def product_type(text: Column) -> Column:
    """The first category one of whose words the text holds; else, and for null, `other`."""
    low, out = F.lower(text), F.when(F.lit(False), "")
    for kind, words in PRODUCT_WORDS.items():
        out = out.when(reduce(Column.__or__, [low.contains(w) for w in words]), kind)
    return out.otherwise("other")


def record_id(text: Column, kind: str) -> Column:
    """The number behind the kind's name, 32 characters at most; blank without one."""
    return F.coalesce(F.substring(F.regexp_extract(text, RECORD_ID[kind], 1), 1, 32), F.lit(""))


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def adjusted(confidence: Column, steps: Sequence[tuple[Column, float]]) -> Column:
    """The confidence plus the steps whose condition holds, within 0..1; a
    condition that is null doesn't hold."""
    return clamped(reduce(Column.__add__, [F.when(when, by).otherwise(0.0) for when, by in steps], confidence))


def name_confidence(value: Column, confidence: Column) -> Column:
    v = F.btrim(value)
    words = F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))
    return adjusted(confidence, [(words >= 2, 0.10), ((words == 1) & (F.char_length(v) <= 3), -0.10), (v.rlike(COMPANY_WORDS), 0.12), ((F.upper(v) == v) & v.rlike("[A-Za-z]"), 0.03), (v.rlike("[0-9]"), -0.15)])


def number_confidence(value: Column, confidence: Column) -> Column:
    v = F.btrim(value)
    return adjusted(confidence, [(v.rlike("^[0-9]+$"), 0.08), (v.rlike("(?i)^(INV|INV-|#)[0-9]+"), 0.10), (F.char_length(v) < 3, -0.15), (F.char_length(v) > 20, -0.10), (v.contains(" "), -0.08)])


def date_confidence(value: Column, confidence: Column) -> Column:
    v, shape = F.btrim(value), "^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})$"
    day, month, year = (F.regexp_extract(v, shape, i).try_cast("int") for i in (1, 2, 3))
    whole = v.rlike("^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}")
    return adjusted(
        confidence,
        [(whole, 0.12), (~whole & v.rlike("^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2}"), 0.05), (v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), 0.15), (v.rlike("[a-zA-Z]{4,}"), -0.10),
         ((month > 12) | (day > 31) | (month == 0) | (day == 0), -0.50), ((year < 100) & (year > 50), -0.20)],
    )


def money_confidence(value: Column, confidence: Column) -> Column:
    v = F.btrim(value)
    bare = F.regexp_replace(v, r"[£$€¥₹,.\s]", "")
    return adjusted(confidence, [(v.rlike(rf"^{SIGN}?\s*[\d,]+\.\d{{2}}$"), 0.15), (v.rlike(SIGN), 0.08), (v.rlike(rf"^{SIGN}?\s*[\d,]+$"), -0.05), (~bare.rlike("^[0-9]+$"), -0.20)])


def address_confidence(value: Column, confidence: Column) -> Column:
    v = F.btrim(value)
    n = F.char_length(v)
    return adjusted(confidence, [(n > 40, 0.10), ((n > 20) & (n <= 40), 0.05), (n < 10, -0.15), (v.rlike(r"(?i)[A-Z]{1,2}\d{1,2}\s*\d[A-Z]{2}"), 0.08), (v.rlike(r"\b\d{5}(?:-\d{4})?\b"), 0.08), (v.contains(","), 0.05)])


def document_confidence(fields: Column, passed: Column, issues: Column) -> Column:
    """The mean of the fields' confidences, 0.7 of it if the structure failed, less
    0.05 for each issue (0.25 at most), within 0..1; 0 without fields."""
    sums = F.aggregate(fields, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.size(fields) > 0, sums / F.size(fields))
    return F.when(mean.isNull(), 0.0).otherwise(clamped(mean * F.when(passed, 1.0).otherwise(0.7) - F.least(issues * 0.05, F.lit(0.25))))


def price_score(price: Column, low: Column, high: Column, discount: Column) -> Column:
    """0..100: 95 for the least price down to 60 for the greatest, 82 where they
    are equal, 4 more with a discount; 65 without a price."""
    base = F.when(F.coalesce(high > low, F.lit(False)), 95.0 - (price - low) / (high - low) * 35.0).otherwise(82.0)
    return F.when(price.isNull(), 65.0).otherwise(clamped(base + F.when(discount, 4.0).otherwise(0.0), 0.0, 100.0))


def terms_and_lead_score(days: Column, most_days: Column, lead: Column, low: Column, high: Column) -> Column:
    """0.6 of the payment terms' score and 0.4 of the lead time's; no value, or 0, has 58 and 62."""
    terms = F.when(days > 0, 60.0 + days / F.greatest(most_days, days) * 35.0).otherwise(58.0)
    wait = F.when(lead > 0, F.when(high > low, 88.0 - (lead - low) / (high - low) * 40.0).otherwise(78.0)).otherwise(62.0)
    return clamped(0.6 * terms + 0.4 * wait, 0.0, 100.0)


def response_score(answered: Column, rounds: Column) -> Column:
    """From the rounds that were answered, of all; 60 before the first."""
    most = F.greatest(answered, rounds)
    return F.when(most > 0, clamped(58.0 + answered / most * 37.0 + F.when(answered >= most, 5.0).otherwise(0.0), 0.0, 100.0)).otherwise(60.0)


def risk_score(risks: Column, pattern: str) -> Column:
    """86 less 14 for each risk that holds the pattern and 8 for each other, 0 at least."""
    hits = F.size(F.filter(risks, lambda s: s.rlike(pattern)))
    return F.greatest(F.lit(0.0), 86.0 - hits * 14.0 - (F.size(risks) - hits) * 8.0)


def green_score(green: Column, ideas: Column) -> Column:
    return F.when(F.size(green) > 0, 82.0).when(F.size(ideas) > 0, 74.0).otherwise(48.0)
