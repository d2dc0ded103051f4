"""Recognisers over text: amounts, prices, phones, addresses, sentences, names and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Currency marks and codes, an amount, and the shapes of phones, dates and addresses.
SYMBOL = r"(?:US\$|A\$|C\$|NZ\$|S\$|HK\$|R\$|[$£€¥₹₩₽₺₪฿₫₱₦])"
CODE = r"(?:USD|EUR|GBP|INR|CAD|AUD|NZD|SGD|HKD|JPY|CNY|CHF|SEK|NOK|DKK|PLN|CZK|HUF|BRL|MXN|ZAR|AED|SAR|KRW|RUB|TRY|ILS|THB|IDR|MYR|PHP|VND|NGN|Rs\.?|kr\.?|zł|Kč)"
AMOUNT = r"\d(?:[\d.,\u00a0\u202f]*\d)?"
PRICE_BEFORE = rf"(?:{SYMBOL}|(?<![A-Za-z]){CODE})[\s\u00a0\u202f]?({AMOUNT})"
PRICE_AFTER = rf"({AMOUNT})[\s\u00a0\u202f]?(?:{SYMBOL}|{CODE}(?![A-Za-z]))"
PRICE = rf"{PRICE_BEFORE}|{PRICE_AFTER}"
PHONE = r"(?<![\w/.-])\+?\(?\d[\d\s().\-\u00a0]{5,20}\d(?![\w/-])"
DATE_LIKE = r"^\s*(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\s*$"
EMAIL = r"(?<![\w@.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?!png\b|jpe?g\b|svg\b|webp\b|gif\b)[A-Za-z]{2,}\b"
SENTENCE = r"[^.!?]{25,}+[.!?]"  # no terminator can be inside, so a possessive run finds the shortest match
QUESTION = r"(?i)^\s*(what|who|why|how|when|where|which|can|do|does|is|are|will|should)\b.*\?\s*$"
REFERRING = r"(?i)^\s*(this|these|those|it|they|our platform|our product|the above|as mentioned|as noted|as described above|the former|the latter)\b"
LEGAL_SUFFIX = r"(?i)\b(inc|ltd|llc|l\.l\.c|gmbh|s\.a|sa|plc|co|corp|corporation|limited)\b\.?"
COPYRIGHT = r"(?i)(?:©|&copy;|copyright)\s*(?:\d{4}\s*[-–]\s*)?(\d{4})"
ISO_DATE = r"(?<!\d)20\d{2}-\d{2}-\d{2}(?!\d)"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def amount(text: Column) -> Column:
    """A displayed amount as a number, whichever way its groups and decimals are marked; null if it is none."""
    s = F.regexp_replace(text, r"[\s\u00a0\u202f]", "")
    commas, dots = F.length(s) - F.length(F.replace(s, F.lit(","))), F.length(s) - F.length(F.replace(s, F.lit(".")))
    last_comma, last_dot = F.length(s) - F.instr(F.reverse(s), ","), F.length(s) - F.instr(F.reverse(s), ".")
    both = F.when(last_comma > last_dot, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    plain = (
        F.when((commas > 0) & (dots > 0), both)
        .when((commas > 1) | s.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(s, F.lit(","), F.lit("")))
        .when(commas > 0, F.replace(s, F.lit(","), F.lit(".")))
        .when((dots > 1) | s.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(s, F.lit("."), F.lit("")))
        .otherwise(s)
    )
    return F.round(F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain).cast("double"), 2)


def prices(text: Column) -> Column:
    """All currency-marked numbers of a text, read before and after their mark, as sorted numbers."""
    found = F.array_union(every(text, PRICE_BEFORE, 1), every(text, PRICE_AFTER, 1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, amount), lambda x: x.isNotNull())))


def price(text: Column) -> Column:
    return first(text, PRICE)


def is_phone(candidate: Column) -> Column:
    """Seven to fifteen digits that are no date, no pair of years and no bare run of digits."""
    c = F.trim(candidate)
    digits = F.length(F.regexp_replace(c, r"\D", ""))
    groups = every(c, r"\d+")
    years = F.forall(groups, lambda g: (F.length(g) == 4) & F.substring(g, 1, 2).isin("19", "20"))
    marked = c.startswith("+") | c.contains("(")
    side_by_side = (F.size(groups) == 2) & ~c.rlike(r"\d[-.]\d")
    grouped = (F.size(groups) >= 2) & ~F.forall(groups, lambda g: F.length(g) == 4)
    return digits.between(7, 15) & ~c.contains(",") & ~c.rlike(DATE_LIKE) & ~years & (marked | (~side_by_side & grouped))


def phone(text: Column) -> Column:
    return F.trim(F.get(F.filter(every(text, PHONE), is_phone), F.lit(0)))


def email(text: Column) -> Column:
    return first(text, EMAIL)


FACTS = {"price": price, "phone": phone, "email": email}


def tier(fact: str, shown: Column, markup: Column, meta: Column, payload: Column) -> Column:
    """0: in the visible text, 1: in structured data, 2: only in meta tags or scripts, 3: nowhere."""
    find = FACTS[fact]
    return F.when(find(shown).isNotNull(), 0).when(find(markup).isNotNull(), 1).when(find(meta).isNotNull() | find(payload).isNotNull(), 2).otherwise(3)


def sentences(text: Column) -> Column:
    return F.transform(every(text, SENTENCE), lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))))


def words(text: Column) -> Column:
    """Number of words; an empty text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def name_tokens(name: Column) -> Column:
    """A brand's words, without case, punctuation and legal form."""
    return F.array_sort(F.array_distinct(every(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), LEGAL_SUFFIX, " "), "[a-z0-9]{2,}")))


def copyright_years(text: Column) -> Column:
    return F.transform(every(text, COPYRIGHT, 1), lambda y: y.cast("int"))


def months_since(now: Column, day: Column) -> Column:
    """From an ISO day to ``now``; a day that does not exist counts as now."""
    then = F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))
    return F.coalesce(F.datediff(now, then) / 30.44, F.lit(0.0))


def http_day(header: Column) -> Column:
    """The ISO day of an RFC 1123 date, or null."""
    return F.date_format(F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd")
