"""Expressions that clean field values: names, subjects, addresses, free text,
numbers in replies, statuses and confidences. Built-in expressions; a null gives
null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions.columns import alias_key, rounded

BLANK = "[ \\t\\r\\n\\f]+"
#: Legal forms that a company's name loses, and words that don't count in it. Fixed values.
LEGAL_WORDS = ("ltd", "limited", "llc", "inc", "plc", "corp", "corporation", "gmbh", "sa", "s.a", "pty", "co", "company", "group", "partners", "llp", "lp", "and sons")
NOISE_WORDS = ("and", "the", "of", "for", "a", "an", "&", "etc")
#: Words before an identifier of any kind, and before a number. Fixed values.
KEYED_WORDS = ("workflow", "session", "event", "trace", "dispatch", "message")
NUMBERED_WORDS = ("supplier", "rfq", "po", "invoice", "contract")
LEGAL_FORMS = rf"(?:\b(?:{'|'.join(w.replace('.', '[.]').replace(' ', ' +') for w in sorted(LEGAL_WORDS, key=len, reverse=True))})\b|& sons\b)[.]?"
_TOKEN = "[A-Za-z0-9_-]"
#: What goes from texts, in this order: marks of a run, identifiers behind their words, numbers behind theirs, names of agents.
IDENTIFIERS = (
    rf"(?i)proc-?wf-{_TOKEN}+",
    rf"(?i)\b(?:{'|'.join(KEYED_WORDS)})(?:[-_: ]*(?:id|ref|run|context)\b)?[-_:=\s]*{_TOKEN}{{4,}}\b",
    rf"(?i)\b(?:{'|'.join(NUMBERED_WORDS)})(?: *(?:number|no|id|reference)\b[.]?)?[-:# ]*{_TOKEN}*\d{_TOKEN}*\b",
    rf"(?i)\b(?:{_TOKEN}+_agent|learning[_-]?[a-z0-9]+)\b",
    r"\b(?:[A-Z][a-z]+)+Agent\b",
)
#: Texts that stand for a missing value. Fixed values.
MISSING = ("", "None", "null", "nan", "NaN", "<NA>")


def slug(c: Column) -> Column:
    """Snake case: an underscore before capitals and digits, other runs are one; blank is null."""
    parted = F.regexp_replace(F.btrim(c), "([A-Z0-9])", "_$1")
    return F.nullif(F.btrim(F.lower(F.regexp_replace(parted, "[^A-Za-z0-9]+", "_")), F.lit("_")), F.lit(""))


def company_key(c: Column) -> Column:
    """A company's name in lower case without legal forms and punctuation."""
    bare = F.regexp_replace(F.lower(F.btrim(c)), LEGAL_FORMS, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, "[,.&'\"-]+", " "), BLANK, " "))


def core_words(c: Column) -> Column:
    """The distinct words of a company's key that tell it from others, sorted."""
    words = F.array_distinct(F.split(company_key(c), " "))
    return F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(*NOISE_WORDS)))


def spellings(c: Column) -> Column:
    """The distinct ways to write a name: as it is, lower, without legal form, letters and digits only."""
    return F.array_distinct(F.filter(F.array(F.btrim(c), F.lower(F.btrim(c)), company_key(c), alias_key(c)), lambda x: x.isNotNull() & (x != "")))


def unlisted(c: Column) -> Column:
    """Trimmed; texts that stand for a missing value are null."""
    t = F.btrim(c)
    return F.when(~t.isin(*MISSING), t)


def subject_key(c: Column) -> Column:
    """A subject without reply and forward marks, in lower case; blank is null."""
    t = F.regexp_replace(F.btrim(c, F.lit(" \t\r\n\f")), BLANK, " ")
    t = F.btrim(F.replace(F.replace(t, F.lit("Re:"), F.lit("")), F.lit("Fwd:"), F.lit("")))
    t = F.when(F.startswith(F.lower(t), F.lit("re: ")), F.btrim(F.substr(t, F.lit(5)))).otherwise(t)
    return F.nullif(F.lower(t), F.lit(""))


def address_of(c: Column) -> Column:
    """The address of `Name <address>` or of a bare one, in lower case."""
    inner = F.regexp_extract(c, "<([^<>]*)>", 1)
    return F.nullif(F.lower(F.btrim(F.when(inner != "", inner).otherwise(c))), F.lit(""))


def domain_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(address_of(c), "@(.+)", 1), F.lit(""))


def plain_text(c: Column) -> Column:
    """Letters, digits, `_ - . , : / @` and single spaces; null gives ''."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_ \t\r\n\f.,:/@-]", "")
    return F.btrim(F.regexp_replace(kept, BLANK, " "))


def without_identifiers(c: Column) -> Column:
    """Without workflow, session, order and agent identifiers; null gives ''."""
    out = F.coalesce(c, F.lit(""))
    for pattern in IDENTIFIERS:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, BLANK, " "), " +([,.;:])", "$1")
    return F.btrim(out, F.lit(" ,;-"))


def wanted_count(c: Column, default: int = 3) -> Column:
    """N of `top N` in a question, else the default."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "(?i)top[- \\t\\r\\n\\f]*([0-9]{1,9})", 1), F.lit("")).cast("int"), F.lit(default))


def first_number(c: Column) -> Column:
    """The first number of a text."""
    return F.regexp_extract(c, "([0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")


def offered_price(c: Column) -> Column:
    """The first number of a reply; commas go."""
    return F.replace(F.regexp_extract(c, "([0-9]+[.,]?[0-9]*)", 1), F.lit(","), F.lit("")).try_cast("double")


def offered_days(c: Column) -> Column:
    """N of the first `N days` of a reply."""
    return F.regexp_extract(c, "(?i)([0-9]+)[ \\t\\r\\n\\f]*days", 1).try_cast("long")


def money_text(c: Column) -> Column:
    """A number without currency signs, blanks and commas; other texts stay."""
    bare = F.replace(F.regexp_replace(c, "[£$€¥₹ \\t\\r\\n\\f]", ""), F.lit(","), F.lit(""))
    return F.when(bare.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"), bare).otherwise(c)


def tax_percent(net: Column, tax: Column) -> Column:
    """To one digit; null without a positive net."""
    return F.when(net > 0, rounded(tax / net * 100, 1))


def responsiveness(hours: Column) -> Column:
    return F.when(hours.isNull(), "Unknown").when(hours < 24, "Very Responsive").when(hours < 72, "Moderate").otherwise("Slow")


def number_or(c: Column, default: float = 0.0) -> Column:
    """As a number; what is none or not a number is the default."""
    value = c.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(value)


def unless_doubtful(value: Column, document: Column, field: Column, least_document: float = 0.65, least_field: float = 0.6) -> Column:
    """Null where the document's and the field's confidence are low; the
    document's counts where the field has none."""
    low = (F.coalesce(document, F.lit(0.0)) < least_document) & (F.coalesce(field, document, F.lit(0.0)) < least_field)
    return F.when(~low, value)


def mapped(c: Column, scores: dict[str, float], default: float) -> Column:
    """A category's score."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k in sorted(scores) for x in (k, float(scores[k]))]), c), F.lit(default))


def listed(c: Column, separator: str = ",") -> Column:
    """The parts of a list in a text, blanks left out."""
    return F.filter(F.split(c, f"[{separator}]"), lambda x: x != "")


def levels_key(*levels: Column) -> Column:
    """Category levels in lower case joined by `>`, blanks left out."""
    return F.concat_ws(">", *[F.nullif(F.lower(F.btrim(x)), F.lit("")) for x in levels])


def distinct_ignoring_case(c: Column) -> Column:
    """The first of entries that differ by case only, in order."""
    low = F.transform(c, lambda x: F.lower(x))
    return F.filter(c, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def chunk_key(record: Column, number: Column) -> Column:
    """The name-based UUID (version 5) of a number in a record's UUID."""
    h = F.sha1(F.concat(F.unhex(F.replace(record, F.lit("-"), F.lit(""))), F.encode(number.cast("string"), "utf-8")))
    at = lambda start, n: F.substring(h, start, n)
    variant = F.translate(at(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


#: States that end a flow well or badly. Fixed values.
DONE = ("completed", "complete", "success", "successful", "succeeded", "done", "ok", "okay", "pass", "passed", "finished", "resolved", "true", "yes")
NOT_DONE = ("failed", "failure", "error", "errored", "exception", "timeout", "timed_out", "cancelled", "canceled", "aborted", "rejected", "denied", "false", "no")


def completion(c: Column) -> Column:
    """sign (1 or -1), label and recognised of a state in words or numbers; a
    null, blank or unknown one is failed and not recognised."""
    token = F.lower(F.btrim(c))
    number = token.try_cast("double")
    numeric = number.isNotNull() & ~F.isnan(number)
    done = F.coalesce(token.isin(*DONE) | (numeric & (number > 0)), F.lit(False))
    known = F.coalesce(token.isin(*DONE, *NOT_DONE) | numeric, F.lit(False))
    return F.struct(F.when(done, 1).otherwise(-1).alias("sign"), F.when(done, "completed").otherwise("failed").alias("label"), known.alias("recognised"))


#: Currencies of offers and the signs of some. Fixed values.
CURRENCIES = ("USD", "EUR", "GBP", "INR", "AUD", "CAD", "SGD", "CHF", "JPY", "NOK", "SEK", "DKK")
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR"}
AMOUNT = "[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?"
NET_DAYS = "(?i)net[ ]*([0-9]+)"
DURATION = "(?i)([0-9]+(?:[.][0-9]+)?)[ ]*((?:business[ ]+)?(?:days?|weeks?))"
MONEY_OF = f"(?i)({'|'.join(CURRENCIES)}|[€$£₹])[ ]*{AMOUNT}"
PRICED = f"(?i)(?:{'|'.join(CURRENCIES)}|[€$£₹]|price|offer)[^A-Za-z0-9]{{0,3}}({AMOUNT})"
#: Words that mark a sentence of a reply as a risk or as sustainability. Fixed values.
RISK_WORDS = "(?i)(delay|risk|issue|concern|backlog|unavailable|unable|cannot|excess cost)"
GREEN_WORDS = "(?i)(sustainab|esg|green|recycl|carbon|ethical|inclusive|diversity)"


def _last(c: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def without_periods(c: Column) -> Column:
    """A reply without payment terms and durations, whose numbers are no prices."""
    return F.regexp_replace(F.regexp_replace(c, DURATION, " "), NET_DAYS, " ")


def last_price(c: Column) -> Column:
    """The last number of a reply that follows a currency or the word price or offer."""
    return F.replace(_last(without_periods(c), PRICED, 1), F.lit(","), F.lit("")).try_cast("double")


def last_currency(c: Column) -> Column:
    """The code of the last currency that an amount follows."""
    found = F.upper(_last(without_periods(c), MONEY_OF, 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair]), found), found)


def net_days(c: Column) -> Column:
    """N of the first `net N`."""
    return F.regexp_extract(c, NET_DAYS, 1).try_cast("long")


def lead_days(c: Column) -> Column:
    """The last duration in whole days, halves to the even one; a week has seven."""
    weeks = F.lower(_last(c, DURATION, 2)).contains("week")
    return F.bround(_last(c, DURATION, 1).try_cast("double") * F.when(weeks, 7).otherwise(1)).cast("long")


def sentences_with(c: Column, pattern: str) -> Column:
    """The sentences of a text that hold the pattern, in order."""
    parts = F.split(F.regexp_replace(c, "([.!?])[ \\t\\r\\n\\f]+", "$1\u0001"), "\u0001")
    return F.transform(F.filter(parts, lambda s: s.rlike(pattern)), lambda s: F.btrim(s))
