"""Masking by rules: links, times, dates, years, tickers, numbers in digits and words, and the article's own firm.

Stays in the JVM. People, places and products have no pattern: they need a dictionary
(``entities``) or a responder.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anontext.functions.names import LEGAL_FORMS
from anontext.functions.text import let
from anontext.operators.responders import Call, ExpressionResponder

_MONTH = ("(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|"
          "Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\\.?")
_DAY = "[0-9]{1,2}(?:st|nd|rd|th)?"
_TICKER = "[A-Z]{1,5}(?:\\.[A-Z])?"
# Exchanges that stand before a ticker.
_EXCHANGE = "NYSE|NASDAQ|Nasdaq|AMEX|ARCA|OTC|OTCMKTS|LSE|TSX|TSXV|ASX|HKEX|HKG|ETR|EPA|TYO"
_CURRENCY = "(?:US[$]|C[$]|A[$]|USD|EUR|GBP|[$€£¥])"
_UNIT = ("(?i:percent|per cent|percentage points?|basis points?|bps|thousand|million|billion|trillion|"
         "mn|bn|[kmb]|dollars?|cents?|euros?|USD|EUR|GBP|shares?|units?|"
         "km|kg|tons?|tonnes?|barrels?|miles?|years?|months?|weeks?|days?|hours?|minutes?)")
# Number words.
_ONES = ("two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|"
         "sixteen|seventeen|eighteen|nineteen|zero")
_TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
_BIG = "hundred|thousand|million|billion|trillion|dozen"
_ORDINAL = ("third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|"
            "fifteenth|sixteenth|seventeenth|eighteenth|nineteenth|twentieth|thirtieth|fortieth|fiftieth|"
            "sixtieth|seventieth|eightieth|ninetieth|hundredth|thousandth|millionth|billionth")

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# A value is masked whole: digits with what is written onto them, a currency before and any number of units after.
# Loops over groups are possessive: they neither recurse as deep as a junk line is long nor try again.
_UNITS = f"(?:[ -](?:{_UNIT}){_AFTER})*+"
_DIGITS = r"[0-9]++(?:[.,]++[0-9]++)*+[\p{L}\p{N}_]*+(?: ?%)?"
_PART = r"[0-9]++[.,]++[0-9]++(?:[.,]++[0-9]++)*+[\p{L}\p{N}_]*+(?: ?%)?"
_VALUE = (f"{_CURRENCY} ?{_DIGITS}{_UNITS}|{_PART}{_UNITS}|[0-9]++[\\p{{L}}\\p{{N}}_]*+"
          f"(?: ?%|[ -](?:{_UNIT}){_AFTER}){_UNITS}")
# Number words run on as long as they are joined by a space or hyphen. Alone, "one", "first" and "second" are no numbers.
_MORE = (f"(?:[ -](?:(?:{_BIG})s?(?: and (?:one|{_ONES}|{_TENS}))?|one|{_ONES}|{_TENS}|"
         f"(?:first|second|{_ORDINAL})s?|half|halves|quarters?){_AFTER})")
_NUMBER_WORDS = (f"(?i:(?:{_ONES}|{_TENS}){_AFTER}{_MORE}*+{_UNITS}|one{_AFTER}(?:{_MORE}++{_UNITS}|[ -](?:{_UNIT}){_AFTER}{_UNITS})|"
                 f"(?:an? )?(?:{_BIG})s?(?: and (?:one|{_ONES}|{_TENS}))?{_AFTER}{_MORE}*+{_UNITS}|(?:{_ORDINAL})s?{_AFTER}{_UNITS})")

# Placeholder and pattern of each class, in the order they are applied. A pattern stands between
# characters that are no letters, digits or underscores. A mail address has 64 characters before its @, a domain
# 127 labels at most. Values that show they are no years come before years.
CLASSES = (
    ("link_x", "(?i:https?://|ftp://|www\\.)[^ \\t\\r\\n<>\"]*[^ \\t\\r\\n<>\".,;:!?)'\\]]"
     "|[A-Za-z0-9][A-Za-z0-9._%+'-]{0,63}+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+){0,125}\\.[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]"
     "|[A-Za-z0-9-]{1,63}+(?:\\.[A-Za-z0-9-]{1,63}+){0,125}\\.(?:[a-z]{2,63}|[A-Z]{2,63})"),
    ("time_x", "[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AaPp]\\.?[Mm]\\.?)?|[0-9]{1,2} ?[AaPp]\\.?[Mm]\\.?|(?i:noon|midnight)"),
    ("date_x", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
               "(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
               "|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{1,2}\\.[0-9]{1,2}\\.(?:[0-9]{4}|[0-9]{2})|"
               f"{_MONTH} {_DAY}(?:,? [0-9]{{4}})?|{_DAY} {_MONTH}(?:,? [0-9]{{4}})?|{_MONTH} [0-9]{{4}}"
               "|(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|Q[1-4](?: ?[0-9]{4}| ?['’][0-9]{2}|[0-9]{2})?"
               "|[1-4]Q ?(?:[0-9]{4}|['’]?[0-9]{2})"
               "|(?:January|February|March|April|May|June|July|August|September|October|November|December)"),
    ("number_x", _VALUE),
    ("year_x", "(?:FY ?)?(?:19|20)[0-9]{2}[sE]?|FY ?[0-9]{2}"),
    ("ticker_x", f"(?:{_EXCHANGE})(?: [A-Z]+)?: ?{_TICKER}|SYMBOL(?:: ?| ){_TICKER}|[$>] ?{_TICKER}"),
    ("number_x", f"{_DIGITS}|{_NUMBER_WORDS}"),
)

# What a match of each class begins with: looked at before anything else, as most places fail there.
_FIRST = ("[A-Za-z0-9-]", "[0-9NnMm]", "[0-9JFMASONDTWQ]", "[0-9UCAEG$€£¥]", "[F12]", "[NAOLTHES$>]", "[0-9TtFfSsEeNnZzOoAaHhMmBbDd]")

_FORM = "|".join(form.replace(".", r"\.") for form in LEGAL_FORMS)


def mask_patterns(text: Column, lettered: bool = False) -> Column:
    """Replace every class of pattern by its placeholder.

    ``lettered`` tells values apart: a text's first number becomes number_a, the next other one number_b, and equal ones share
    a letter.
    """
    if not lettered:
        return _replace_classes(text, CLASSES, _FIRST)
    text = F.translate(text, _OPEN + _CLOSE, "")
    first = [placeholder for placeholder, _ in CLASSES].index("number_x") + 1
    text = _replace_classes(text, CLASSES[:first], _FIRST[:first], f"{_OPEN}$0{_CLOSE}")

    # What is marked already is out of reach of the classes that follow.
    def others(piece: Column, at: Column) -> Column:
        value, rest = _value_and_rest(piece)
        masked = _replace_classes(F.when(at == 0, piece).otherwise(rest), CLASSES[first:], _FIRST[first:], f"{_OPEN}$0{_CLOSE}")
        return F.when(at == 0, masked).otherwise(F.concat(value, F.lit(_CLOSE), masked))

    return _letter_numbers(F.array_join(F.transform(F.split(text, _OPEN, -1), others), _OPEN))


def _replace_classes(text: Column, classes, firsts, number: str = "number_x") -> Column:
    for (placeholder, pattern), begin in zip(classes, firsts, strict=True):
        text = F.regexp_replace(text, f"(?={begin}){_BEFORE}(?:{pattern}){_AFTER}", number if placeholder == "number_x" else placeholder)
    return text


# Marks around a number until it has its letter: characters that no text may hold.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_LETTERS = 5


def letters(index: Column) -> Column:
    """0 is a, 25 is z, 26 is aa, and so on for twelve million values."""
    out, rest = F.lit(""), index.cast("long")
    for _ in range(_LETTERS):
        out = F.concat(F.when(rest >= 0, F.char(F.lit(97) + F.pmod(rest, F.lit(26)))).otherwise(""), out)
        rest = F.floor(rest / 26) - 1
    return out


def _value_and_rest(piece: Column) -> tuple[Column, Column]:
    """A piece between opening marks: the number, and the text after its closing mark."""
    return F.substring_index(piece, _CLOSE, 1), F.substring(piece, F.instr(piece, _CLOSE) + 1, F.length(piece))


def _letter_numbers(text: Column) -> Column:
    """Marked numbers by order of first mention; spaces, commas and case do not tell values apart."""
    def numbered(pieces: Column) -> Column:
        # Each piece but the first is a number, the closing mark and the text up to the next number.
        after = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        halves = F.transform(after, lambda p: F.struct(
            F.lower(F.regexp_replace(_value_and_rest(p)[0], "[ ,]", "")).alias("value"), _value_and_rest(p)[1].alias("rest")))
        return let(F.array_distinct(F.transform(halves, lambda h: h["value"])), lambda values: F.concat(
            F.element_at(pieces, 1), F.array_join(F.transform(halves, lambda h: F.concat(
                F.lit("number_"), letters(F.array_position(values, h["value"]) - 1), h["rest"])), "")))

    return let(F.split(text, _OPEN, -1), numbered)


def core_words(name: Column) -> Column:
    """The words of a firm name without bracketed parts, punctuation and legal forms.

    A name of legal forms only keeps its words. Null when there are none.
    """
    bare = F.regexp_replace(F.lower(name), r"\([^)]*\)", " ")
    words = F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")
    telling = F.filter(words, lambda w: ~w.isin(*(f for f in LEGAL_FORMS if "." not in f)))
    kept = F.when(F.size(telling) > 0, telling).otherwise(words)
    return F.when(F.size(kept) > 0, kept)


def mask_firm(text: Column, name: Column, ticker: Column) -> Column:
    """The article's own firm becomes Company_1 and its ticker, however spelled, ticker_x."""
    words = core_words(name)
    pattern = F.concat(F.lit(f"(?iu){_BEFORE}"), F.array_join(words, r"[^\p{L}\p{N}_]+"),
                       F.lit(f"(?:,? (?:{_FORM}){_AFTER}(?:\\.{_AFTER})?)*+{_AFTER}"))  # possessive, so no recursion
    named = F.when(words.isNull(), text).otherwise(F.regexp_replace(text, pattern, F.lit("Company_1")))
    parts = F.filter(F.split(ticker, "[^A-Za-z0-9]+"), lambda p: p != "")
    letters = F.array_join(parts, "")
    # One letter alone is no telling spelling, so it needs its mark; BRK.B is masked with its dot or without.
    mark = F.when(F.length(letters) > 1, F.lit(r"(?:SYMBOL(?:: ?| )|[$>] ?)?")).otherwise(F.lit(r"(?:SYMBOL(?:: ?| )|[$>] ?)"))
    spelled = F.concat(mark, F.lit(_BEFORE), F.array_join(parts, "[./ -]?"), F.lit(_AFTER))
    return F.when(F.coalesce(letters, F.lit("")) == "", named).otherwise(
        F.regexp_replace(named, spelled, F.lit("ticker_x")))


def mask_article(text: Column, name: Column, ticker: Column, lettered: bool = False) -> Column:
    """Own firm and ticker first, since both may hold digits, then the pattern classes."""
    return mask_patterns(mask_firm(text, name, ticker), lettered)


def rule_rewriter(name: str = "comnam", ticker: str = "ticker", lettered: bool = False) -> ExpressionResponder:
    """The rules as a responder for masking steps."""
    def build(call: Call) -> Column:
        return mask_article(call.user, F.col(name), F.col(ticker), lettered)
    return ExpressionResponder(build)
