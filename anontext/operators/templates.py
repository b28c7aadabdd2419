"""Prompts: row-specific templates compiled to one column, and the two fixed prompts."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

# How an empty and a missing cell are printed in a prompt.
EMPTY_CELL = "N/A"
NULL_CELL = "nan"

# The closed list of industry answers.
INDUSTRY_LABELS = (
    "Aerospace", "Agriculture", "Automobiles and Trucks", "Banking", "Beer and Liquor",
    "Construction Materials", "Printing and Publishing", "Shipping Containers",
    "Business Services", "Chemicals", "Computers", "Apparel", "Construction", "Coal",
    "Pharmaceutical Products", "Electrical Equipment", "Fabricated Products",
    "Financial Services", "Food Products", "Recreation", "Precious Metals", "Defense",
    "Computer Hardware", "Healthcare", "Consumer Goods", "Insurance",
    "Measuring and Control Equipment", "Machinery", "Restaurants, Hotels, and Motels",
    "Medical Equipment", "Non-Metallic and Industrial Mining", "Petroleum and Natural Gas",
    "Paper", "Personal Services", "Real Estate", "Retail", "Rubber and Plastic Products",
    "Shipbuilding", "Railroad Equipment", "Tobacco Products", "Candy and Soda", "Software",
    "Steel Works", "Communication", "Entertainment", "Transportation", "Textiles", "Utilities",
    "Wholesale",
)

# Answer layouts that the extraction reads.
GUESS_LAYOUT = ("**Ticker Estimate: TIKR**,**Name Estimate: NAME**,"
                "**Industry Estimate: IND**,**Date Estimate: YYYY-MM-DD**")
SENTIMENT_LAYOUT = "**Direction Estimate: DIRECTION**,**Magnitude Estimate: MAGNITUDE**"

# The ways a ticker may be spelled in a text.
TICKER_SPELLINGS = ("SYMBOL:TIKR", "$TIKR", ">TIKR", "$ TIKR", "SYMBOL TIKR", "SYMBOL: TIKR", "> TIKR")

_REPLACEMENTS = (
    "Replace, never delete. Firms become Company_1, Company_2 and so on, the firm above first. "
    f"A ticker, however it is spelled ({', '.join(TICKER_SPELLINGS)}), becomes ticker_x. "
    "People become name_x, places location_x, industries industry_x, sectors sector_x, products product_x, kinds of product product_type_x, lines of "
    "products product_line_x, services service_x, slogans slogan_x. Points in time become time_x, "
    "years year_x, dates date_x, web addresses link_x, and numbers and percentages, units "
    "included, become number_x. ")
_ONLY_TEXT = "Return the rewritten text and nothing else."
_RETRY = ("An earlier attempt left clues and a reader named the firm or the date. "
          "Be stricter this time and leave no detail that could help. ")


def _about_firm(name_lead: str, ticker_lead: str, industry_lead: str, gap: str) -> list[dict]:
    return [
        {"column": "comnam", "prefix": name_lead, "suffix": gap},
        {"column": "ticker", "prefix": ticker_lead, "suffix": gap},
        {"column": "industry", "prefix": industry_lead, "suffix": ". "},
    ]


_MASK_FIRM = _about_firm("The text is about the firm ", "with the ticker ", "in the industry ", " ")
_PARA_FIRM = _about_firm("The text concerns the firm ", "its ticker is ", "its industry is ", ", ")
_MASK_TASK = "Mask everything in the user's text that could tell a reader which firm it is about. "
_PARA_TASK = ("Say the user's text again in other words and other sentence structures, keeping its "
              "content and roughly its length, so that nobody who knows it by heart would notice. ")
_PARA_RULES = ("Names, acronyms, dates, agencies, products and anything tied to an industry must "
               "be replaced by anonymous stand-ins. ")

MASK_TEMPLATE = {"template": [_MASK_TASK, *_MASK_FIRM, _REPLACEMENTS, _ONLY_TEXT]}
MASK_TEMPLATE_ITER = {"template": [_MASK_TASK, _RETRY, *_MASK_FIRM, _REPLACEMENTS, _RETRY, _ONLY_TEXT]}
PARA_TEMPLATE = {"template": [_PARA_TASK, *_PARA_FIRM, _PARA_RULES, _ONLY_TEXT]}
PARA_TEMPLATE_ITER = {"template": [_PARA_TASK, _RETRY, *_PARA_FIRM, _PARA_RULES, _RETRY, _ONLY_TEXT]}

GUESS_PROMPT = (
    "The user's text has been anonymised. Work out which company it is about, the industry of "
    "that company and the day it was written; when unsure, give your best guess. The industry "
    f"must be one of: {', '.join(INDUSTRY_LABELS)}. Answer in exactly this layout and add "
    f"nothing (TIKR is the ticker, NAME the firm, IND the industry): {GUESS_LAYOUT}")

SENTIMENT_PROMPT = (
    "You judge news for an investor. Say whether the user's text is bad (direction 0) or good "
    "(direction 1) news for the future return of the security it is about, or NA when it says "
    "nothing that matters for prices, and how strongly, as a magnitude from 0 (slightly) to 1 "
    f"(highly). Answer in exactly this layout and add nothing: {SENTIMENT_LAYOUT}")


# Required input columns and their names here; templates may use either.
SOURCE_COLUMNS = {
    "Body Text": "body",
    "COMNAM": "comnam",
    "Companies": "ticker",
    "SIC_Industry": "industry",
    "Date": "pub_date",
}


def compile_prompt(template: str | dict, columns: list[str], null_text: str = NULL_CELL) -> Column:
    """A string or a ``{"template": [...]}`` of literals and column parts, as one Column.

    Source names of columns stand for their names here where only those are there. A part naming an unknown
    column, and a part of neither form, is left out with a warning.
    """
    if isinstance(template, str):
        return F.lit(template)
    if not isinstance(template, dict) or "template" not in template:
        raise ValueError("a prompt is a string or a dict with the key 'template'")
    pieces: list[Column] = []
    literal = ""
    for part in template["template"]:
        if isinstance(part, str):
            literal += part
        elif not isinstance(part, dict) or "column" not in part:
            warnings.warn(f"prompt part {part!r} is neither text nor a column", stacklevel=2)
        elif (name := part["column"] if part["column"] in columns else SOURCE_COLUMNS.get(part["column"])) not in columns:
            warnings.warn(f"prompt column {part['column']!r} not found", stacklevel=2)
        else:
            cell = F.col(f"`{name}`").cast("string")
            if literal + part.get("prefix", ""):
                pieces.append(F.lit(literal + part.get("prefix", "")))
            pieces.append(F.when(cell == "", F.lit(EMPTY_CELL)).otherwise(
                F.coalesce(cell, F.lit(null_text))))
            literal = part.get("suffix", "")
    if literal or not pieces:
        pieces.append(F.lit(literal))
    return F.concat(*pieces)
