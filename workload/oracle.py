"""The same results as ``queries``, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from anontext.operators import templates
from anontext.operators.budget import EMPTY_ANSWER
from workload import fixtures as fx
from workload.queries import PLAN_LIMIT, PLAN_SPAN, SPELLED_DATES, SPELLINGS, WRITTEN


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*ctes: tuple[str, str], body: str, recursive: bool = False) -> str:
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return fx.for_duckdb(f"WITH {'RECURSIVE ' if recursive else ''}{listed}\n{body}")


ARTICLES = ("articles", fx.ARTICLES)


# --- prompts ---

def _prompt(template: dict) -> str:
    parts = []
    for part in template["template"]:
        if isinstance(part, str):
            parts.append(_quote(part))
        else:
            c = part["column"]
            parts += [_quote(part["prefix"]),
                      f"CASE WHEN {c} IS NULL THEN 'nan' WHEN {c} = '' THEN 'N/A' ELSE {c} END",
                      _quote(part["suffix"])]
    gaps = ", ".join(f"CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '' ELSE {c} END AS {c}"
                     for c in ("comnam", "ticker", "industry"))
    return _with(ARTICLES, ("rows_", f"SELECT doc_id, {gaps} FROM articles"),
                 body=f"SELECT doc_id, concat({', '.join(parts)}) AS prompt FROM rows_")


# --- extraction ---

PLAIN = "trim(regexp_replace(regexp_replace(response, '[*`_]', '', 'g'), '\\s+', ' ', 'g'))"
LABELS = "(?:ticker|name|date|year|industry|sector) estimate"


def _guess(label: str) -> str:
    found = (f"trim(rtrim(trim(regexp_extract(plain, '(?i)(?:{label}) ?estimate ?: ?(.*?) ?[,;]? ?"
             f"(?:(?:ticker|name|date|year|industry|sector) ?estimate|$)', 1)), ',;'))")
    return (f"CASE WHEN plain IS NULL OR lower({found}) IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'missing') "
            f"THEN 'NA' ELSE {found} END")


GUESSED = ("guessed", f"""
SELECT doc_id, {_guess('ticker')} AS ticker_guess, {_guess('name')} AS name_guess,
  {_guess('date|year')} AS date_guess_raw, {_guess('industry|sector')} AS industry_guess
FROM (SELECT doc_id, {PLAIN} AS plain FROM answers)""")

DIRECTION = "'(?i)direction ?estimate ?: ?(.*?) ?(?:,| magnitude ?estimate|$)'"
MAGNITUDE = "'(?i)magnitude ?estimate ?: ?(.*?) ?(?:,|$)'"


def _sentiment(pattern: str) -> str:
    value = f"trim(regexp_extract(plain, {pattern}, 1))"
    return (f"CASE WHEN plain IS NULL OR NOT regexp_matches(plain, {pattern}) "
            f"OR lower({value}) IN ('na', 'n/a', 'nan', 'none', 'missing') THEN 'NA' ELSE {value} END")


# --- names ---

# The legal forms that a cleaned name loses.
FORMS = ("group|holdings|holding|ltd|corp|inc|co|llc|plc|gmbh|ag|s.a.|s.a|bv|nv|sa|spa|pte|limited|"
         "incorporated|company|corporation|lp|llp|technologies|tech")


def _clean(name: str, forms: str = FORMS) -> str:
    bare = f"regexp_replace(lower({name}), '\\([^)]*\\)', '', 'g')"
    bare = f"regexp_replace({bare}, '[^\\w\\s]', '', 'g')"
    bare = f"regexp_replace({bare}, '\\b(?:{forms})\\b', '', 'g')"
    return f"regexp_replace({bare}, '\\s+', '', 'g')"


# Longest common subsequence by rows of the usual table, one recursion step per character of a.
LCS = """
SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS r FROM pairs
UNION ALL
SELECT a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: greatest(r[j + 1],
  list_max(list_transform(range(1, j + 1), lambda h:
    r[h] + CASE WHEN substr(b, h, 1) = substr(a, i + 1, 1) THEN 1 ELSE 0 END)))))
FROM lcs WHERE i < length(a)"""
SCORES = """
SELECT a, b, cast(CASE WHEN a = b THEN 100 WHEN a = '' OR b = '' THEN 0
  ELSE round_even(100.0::DOUBLE * (2.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b))), 0) END AS INTEGER) AS score
FROM lcs WHERE i = length(a)"""


def _scored(pairs: str, *before: tuple[str, str], body: str) -> str:
    """``pairs`` gives distinct cleaned (a, b); ``scores`` is then at hand in the body."""
    return _with(*before, ("pairs", pairs), ("lcs", LCS), ("scores", SCORES), body=body, recursive=True)


NAME_PAIRS = ("named", f"""
SELECT doc_id, {_clean('comnam')} AS a,
  {_clean("CASE WHEN doc_id % 23 = 0 THEN 'NA' ELSE rival END")} AS b
FROM articles JOIN rivals USING (doc_id)""")
RIVALS = ("rivals", fx.RIVALS)

NAME_SIMILARITY = _scored(
    "SELECT DISTINCT a, b FROM named", ARTICLES, RIVALS, NAME_PAIRS,
    body="SELECT doc_id, score AS similarity, score AS plain_similarity FROM named JOIN scores USING (a, b)")
NAME_SIMILARITY_BY_PAIR = _scored(
    "SELECT DISTINCT a, b FROM named", ARTICLES, RIVALS, NAME_PAIRS,
    body="SELECT doc_id, score AS similarity FROM named JOIN scores USING (a, b)")

# --- dates ---

PARSED = """CASE WHEN regexp_full_match(guess, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')
  THEN try_strptime(guess, '%Y-%m-%d') END"""
WITHIN = "CASE WHEN abs(epoch_us({t}) - epoch_us({g})) <= 7 * 86400000000 THEN 1 ELSE 0 END"

DATE_MATCH = _with(ARTICLES, ("guesses", fx.DATE_GUESSES),
                   ("parsed_", f"SELECT doc_id, true_date, {PARSED} AS parsed FROM guesses"),
                   body=f"SELECT doc_id, parsed, {WITHIN.format(t='true_date', g='parsed')} AS correct FROM parsed_")

CHECK_IDENTIFIED = _scored(
    "SELECT DISTINCT a, b FROM joined", ARTICLES, ("answers", fx.MESSY_GUESSES), GUESSED,
    ("joined", f"""SELECT doc_id, pub_date, {_clean('comnam')} AS a, {_clean('name_guess')} AS b,
        {PARSED.replace('guess', 'date_guess_raw')} AS date_guess
        FROM articles JOIN guessed USING (doc_id)"""),
    body=f"""SELECT doc_id, date_guess, score AS name_similarity_x,
      CASE WHEN score >= 75 THEN 1 ELSE 0 END AS name_guess_correct_x,
      {WITHIN.format(t='pub_date', g='date_guess')} AS date_guess_correct_x,
      CASE WHEN score >= 75 OR {WITHIN.format(t='pub_date', g='date_guess')} = 1 THEN 1 ELSE 0 END
        AS iort_guess_correct_x
      FROM joined JOIN scores USING (a, b)""")


# --- the ladder, in closed form: a text passes at step k or never ---

def _mode(kinds: str, rounds: int) -> tuple[str, str, int]:
    """Prefix of step s, name of step s, and the number of steps."""
    if len(kinds) == 2:
        kind, round_no = "CASE WHEN s % 2 = 0 THEN {m} ELSE {p} END", "(s // 2)"
    else:
        kind, round_no = ("{m}" if kinds == "m" else "{p}"), "s"
    prefix = f"concat('[', {kind.format(m=_quote('m'), p=_quote('p'))}, {round_no}, '] ')"
    name = f"concat({kind.format(m=_quote('masking_step_'), p=_quote('paraphrasing_step_'))}, {round_no})"
    return prefix, name, len(kinds) * (rounds + 1)


def _finished(kinds: str, rounds: int) -> list[tuple[str, str]]:
    prefix, name, steps = _mode(kinds, rounds)
    round_no = "(s // 2)" if len(kinds) == 2 else "s"
    return [ARTICLES, ("at_step", f"""
      SELECT *, least({fx.K}, {steps - 1}) AS s, {fx.K} >= {steps} AS never FROM articles"""),
            ("done", f"""
      SELECT doc_id, comnam, ticker, industry, pub_date, body, s, never,
        concat(array_to_string(list_transform(range(s, -1, -1), lambda s: {prefix}), ''), body) AS neutered_text,
        cast(CASE WHEN never THEN -1 ELSE {round_no} END AS INTEGER) AS neutered_at_round,
        CASE WHEN never THEN 'never_neutered' ELSE {name} END AS neutered_at_step,
        CASE WHEN never AND doc_id % 2 = 0 THEN comnam ELSE '{fx.WRONG_NAME}' END AS name_guess,
        CASE WHEN never AND doc_id % 2 = 1 THEN pub_date ELSE TIMESTAMP '{fx.WRONG_DATE}' END AS date_guess,
        cast(CASE WHEN never AND doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS name_right,
        cast(CASE WHEN never AND doc_id % 2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS date_right,
        cast(CASE WHEN never THEN 1 ELSE 0 END AS INTEGER) AS identified
      FROM at_step""")]


def _ladder(kinds: str, rounds: int = 8) -> str:
    return _scored(
        f"SELECT DISTINCT {_clean('comnam')} AS a, {_clean('name_guess')} AS b FROM done",
        *_finished(kinds, rounds),
        body=f"""SELECT doc_id, comnam, ticker, industry, pub_date, neutered_text, neutered_at_round,
          neutered_at_step, ticker AS ticker_guess_neutered, name_guess AS name_guess_neutered,
          date_guess AS date_guess_neutered, industry AS industry_guess_neutered,
          score AS name_similarity_neutered, name_right AS name_guess_correct_neutered,
          date_right AS date_guess_correct_neutered, identified AS iort_guess_correct_neutered
        FROM done JOIN scores ON a = {_clean('comnam')} AND b = {_clean('name_guess')}""")


def _sentiment_of(text: str, suffix: str) -> str:
    return (f"cast(length({text}) % 2 AS varchar) AS direction{suffix}, "
            f"cast(concat('0.', length({text}) % 100) AS DOUBLE) AS magnitude{suffix}")


def _wide() -> str:
    """Steps of a whole ladder with the answers of each, side by side."""
    columns = []
    for s in range(18):
        name = f"{'masking_step' if s % 2 == 0 else 'paraphrasing_step'}_{s // 2}"
        answer = fx.guess_answer(str(s))
        here, right = f"{s} <= k", f"{s} < k"
        score = f"CASE WHEN {right} AND doc_id % 2 = 0 THEN 100 ELSE score END"
        columns += [
            f"CASE WHEN {here} THEN {answer} END AS guess_response_{name}",
            f"CASE WHEN {here} THEN {score} END AS name_similarity_{name}",
            f"CASE WHEN {here} THEN cast({right} AND doc_id % 2 = 0 AS INTEGER) END AS name_guess_correct_{name}",
            f"CASE WHEN {here} THEN cast({right} AND doc_id % 2 = 1 AS INTEGER) END AS date_guess_correct_{name}",
            f"CASE WHEN {here} THEN cast({right} AS INTEGER) END AS identified_{name}"]
    return _scored(
        f"SELECT DISTINCT {_clean('comnam')} AS a, {_clean(_quote(fx.WRONG_NAME))} AS b FROM articles", ARTICLES,
        body=f"""SELECT doc_id, {', '.join(columns)}
        FROM (SELECT *, {fx.K} AS k FROM articles) JOIN scores ON a = {_clean('comnam')}""")


# --- responders, robustness, batches ---

REPLAY = _with(ARTICLES, body=f"""
SELECT doc_id,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 < 4 THEN {fx.guess_answer('3')}
    WHEN doc_id % 7 = 6 THEN '' END AS text,
  CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 < 4 THEN 'ok' WHEN doc_id % 7 = 4 THEN 'too_long'
    WHEN doc_id % 7 = 5 THEN 'html' ELSE 'error' END AS status
FROM articles""")

ERRORS = f"""
WITH steps AS (
  SELECT doc_id, s, doc_id % 13 AS r, doc_id % 17 AS g, {fx.K} AS k
  FROM documents, (SELECT unnest(range(0, 18)) AS s)),
here AS (
  SELECT * FROM steps WHERE list_bool_and(list_concat([true],
    list_transform(range(0, s), lambda t: r <= t OR g = t OR t < k)))),
bad AS (
  SELECT doc_id, s, 'rewrite' AS stage, CASE WHEN r = s THEN 'too_long' ELSE 'missing' END AS status,
    CASE WHEN r = s THEN 'maximum context length' END AS message FROM here WHERE r <= s
  UNION ALL
  SELECT doc_id, s, 'guess', 'error', 'refused' FROM here WHERE g = s)
SELECT 'failing' AS run_id, doc_id, cast(s AS INTEGER) AS step_no, stage, status, message FROM bad"""

ROBUST = f"""
SELECT model, doc_id, doc_id % 29 <> 0 AND step < {fx.K} AS right_, doc_id % 29 = 0 AS blank, comnam, pub_date
FROM articles, (VALUES ('llama3.2', 3), ('gemma3:4b', 9)) AS m(model, step)"""

WORDS = """
SELECT doc_id, source AS name, text, cast(CASE WHEN doc_id % 31 = 0 THEN 0
  ELSE len(regexp_extract_all(text, '\\S+')) * CASE WHEN doc_id % 5 = 0 THEN 60 ELSE 1 END END AS INTEGER) AS word_count
FROM documents"""

LAST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id DESC) AS n
  FROM words WHERE word_count * 2 <= 120000) WHERE n = 1"""


# --- masking by rules: without look-around, so each pattern runs twice with its neighbours captured ---

_L, _R = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"


def _mask(text: str, placeholder: str, pattern: str, options: str = "g") -> str:
    whole = f"concat('{_L}(?:', {pattern}, '){_R}')"
    for _ in range(2):
        text = f"regexp_replace({text}, {whole}, '\\1{placeholder}\\2', '{options}')"
    return text


_M = ("(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|"
      "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\\.?")
_D = "[0-9]{1,2}(?:st|nd|rd|th)?"
_T = "[A-Z]{1,5}(?:\\.[A-Z])?"
# Exchanges, units and number words, as in the masking rules.
_EXCHANGES = "NYSE|NASDAQ|Nasdaq|AMEX|ARCA|OTC|OTCMKTS|LSE|TSX|TSXV|ASX|HKEX|HKG|ETR|EPA|TYO"
_MONEY = "(?:US[$]|C[$]|A[$]|USD|EUR|GBP|[$€£¥])"
_UNIT = ("(?i:percent|per cent|percentage points?|basis points?|bps|thousand|million|billion|trillion|mn|bn|k|m|b|"
         "dollars?|cents?|euros?|USD|EUR|GBP|shares?|units?|km|kg|tons?|tonnes?|barrels?|miles?|years?|months?|weeks?|days?|hours?|minutes?)")
_SMALL = ("(?:zero|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|"
          "nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)")
_LARGE = f"(?:hundred|thousand|million|billion|trillion|dozen)s?(?: and (?:one|{_SMALL}))?"
_NTH = ("(?:third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth|seventeenth|"
        "eighteenth|nineteenth|twentieth|thirtieth|fortieth|fiftieth|sixtieth|seventieth|eightieth|ninetieth|hundredth|thousandth|"
        "millionth|billionth)s?")
_TAIL = f"(?:[ -]{_UNIT})*"
_FIGURE = "[0-9]+(?:[.,]+[0-9]+)*[\\p{L}\\p{N}_]*(?: ?%)?"
_NEXT = f"(?:[ -](?:{_LARGE}|one|{_SMALL}|firsts?|seconds?|{_NTH}|half|halves|quarters?))"
_WORDS = (f"(?i:(?:{_SMALL}{_NEXT}*|one{_NEXT}+|one[ -]{_UNIT}|(?:an? )?{_LARGE}{_NEXT}*|{_NTH}){_TAIL})")
_PATTERNS = (
    ("link_x", "(?i:https?://|ftp://|www\\.)[^ \\t\\r\\n<>\"]*[^ \\t\\r\\n<>\".,;:!?)''\\]]"
     "|[A-Za-z0-9][A-Za-z0-9._%+''-]{0,63}@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]"
     "|[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.(?:[a-z][a-z]+|[A-Z][A-Z]+)"),
    ("time_x", "[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AaPp]\\.?[Mm]\\.?)?|[0-9]{1,2} ?[AaPp]\\.?[Mm]\\.?|(?i:noon|midnight)"),
    ("date_x", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|"
     f"[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.(?:[0-9]{{4}}|[0-9]{{2}})|{_M} {_D}(?:,? [0-9]{{4}})?|{_D} {_M}(?:,? [0-9]{{4}})?|{_M} [0-9]{{4}}"
     "|(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|Q[1-4] ?[0-9]{4}|Q[1-4] ?[''’][0-9]{2}|Q[1-4][0-9]{2}|Q[1-4]|[1-4]Q ?(?:[0-9]{4}|[''’]?[0-9]{2})"
     "|(?:January|February|March|April|May|June|July|August|September|October|November|December)"),
    ("number_x", f"{_MONEY} ?{_FIGURE}{_TAIL}|[0-9]+[.,]+{_FIGURE}{_TAIL}|[0-9]+[\\p{{L}}\\p{{N}}_]*(?: ?%|[ -]{_UNIT}){_TAIL}"),
    ("year_x", "(?:FY ?)?(?:19|20)[0-9]{2}[sE]?|FY ?[0-9]{2}"),
    ("ticker_x", f"(?:{_EXCHANGES})(?: [A-Z]+)?: ?{_T}|SYMBOL(?:: ?| ){_T}|[$>] ?{_T}"),
    ("number_x", f"{_FIGURE}|{_WORDS}"),
)


def _mask_patterns(text: str, source: str, keys: str) -> str:
    """A chain of sub-queries, one pattern class each."""
    query = f"SELECT {keys}, {text} AS t FROM {source}"
    for placeholder, pattern in _PATTERNS:
        query = f"SELECT {keys}, {_mask('t', placeholder, _quote(pattern).replace(chr(39) * 4, chr(39) * 2))} AS t FROM ({query})"
    return query


_CORE = "regexp_replace(lower(comnam), ' (?:inc|corp [(]new[)]|holdings ltd|co|technologies plc)$', '')"
_OWN = _mask("body", "Company_1", f"concat('(?i:', replace({_CORE}, ' ', '[^\\p{{L}}\\p{{N}}_]+'), "
             f"'(?:,? (?:{FORMS.replace('.', chr(92) + '.')})\\.?)*)')")
_OWN_TICKER = f"""regexp_replace(regexp_replace(t,
  concat('(?:SYMBOL(?:: ?| )|[$>] ?)', ticker, '{_R}'), 'ticker_x\\1', 'g'),
  concat('{_L}', ticker, '{_R}'), '\\1ticker_x\\2', 'g')"""


def _rule_mask(body: str) -> str:
    own = f"SELECT doc_id, ticker, {_OWN} AS t FROM (SELECT doc_id, comnam, ticker, {body} AS body FROM articles)"
    return f"SELECT doc_id, t AS masked FROM ({_mask_patterns(_OWN_TICKER, f'({own})', 'doc_id')})"


def _lettered(text: str, source: str) -> str:
    """Numbers in order of first mention, by cutting texts at marks and numbering distinct values."""
    left = "(^|[^\\p{L}\\p{N}_])"
    query = f"SELECT doc_id, [{{'t': {text}, 'n': 0}}] AS cut FROM {source}"
    for placeholder, pattern in _PATTERNS:
        whole = f"{left}(?:{pattern}){_R}"
        if placeholder != "number_x":
            masked = "c.t"
            for _ in range(2):
                masked = f"regexp_replace({masked}, '{whole}', '\\1{placeholder}\\2', 'g')"
            query = f"SELECT doc_id, [{{'t': CASE WHEN c.n = 1 THEN c.t ELSE {masked} END, 'n': c.n}} FOR c IN cut] AS cut FROM ({query})"
            continue
        # Marked and cut twice, as a match hides its neighbour.
        for _ in range(2):
            marked = f"regexp_replace(c.t, '{left}({pattern}){_R}', '\\1⟦\\2⟧\\3', 'g')"
            query = f"""SELECT doc_id, flatten([CASE WHEN c.n = 1 THEN [c] ELSE flatten([
              CASE WHEN i = 1 THEN [{{'t': p, 'n': 0}}] ELSE [{{'t': split_part(p, '⟧', 1), 'n': 1}}, {{'t': split_part(p, '⟧', 2), 'n': 0}}] END
              FOR p, i IN string_split({marked}, '⟦')]) END FOR c IN cut]) AS cut FROM ({query})"""
    return f"""WITH cuts AS ({query}),
      pieces AS (SELECT doc_id, unnest(range(1, len(cut) + 1)) AS i, unnest(cut) AS c FROM cuts),
      valued AS (SELECT doc_id, i, c.t AS t, c.n AS n, lower(replace(replace(c.t, ' ', ''), ',', '')) AS v FROM pieces),
      firsts AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS k FROM valued WHERE n = 1 GROUP BY doc_id, v)
      SELECT doc_id, string_agg(CASE WHEN n = 0 THEN t ELSE concat('number_', CASE WHEN k >= 702 THEN chr(97 + ((k - 702) // 676)::INTEGER) ELSE '' END,
        CASE WHEN k >= 26 THEN chr(97 + (((k - 26) // 26) % 26)::INTEGER) ELSE '' END, chr(97 + (k % 26)::INTEGER)) END, '' ORDER BY i) AS masked
      FROM valued LEFT JOIN firsts USING (doc_id, v) GROUP BY doc_id"""


def _request(extra: str) -> str:
    return (f"to_json(struct_pack(model := m, messages := [struct_pack(role := 'system', content := 'Guess.'), "
            f"struct_pack(role := 'user', content := body)], top_p := 1, frequency_penalty := 0, "
            f"presence_penalty := 0, logprobs := false, {extra}))::varchar")


_MASK_PROMPT = ", ".join(
    _quote(p) if isinstance(p, str) else f"{_quote(p['prefix'])}, {p['column']}, {_quote(p['suffix'])}"
    for p in templates.MASK_TEMPLATE["template"])

# The dictionary names stand in the lead and in the added sentence only; a rival of the same name
# as the article's firm is that firm.
ENTITY_MASK = _with(ARTICLES, ("rivals", fx.RIVALS), body="""
SELECT doc_id, concat('Company_1', substr(body, length(core) + 1, instr(body, ' that ') + 5 - length(core)), 'industry_x',
  substr(body, instr(body, ' that ') + 6 + length(industry)),
  ' Its rival ', other, ' lost to ', other, ' Inc in industry_x.') AS masked
FROM (SELECT *, CASE WHEN rival = lower(core) THEN 'Company_1' ELSE 'Company_2' END AS other
  FROM (SELECT a.*, rival, substr(body, 1, instr(body, ' ($') - 1) AS core FROM articles a JOIN rivals USING (doc_id)))""")


def _template_prompt(template: dict) -> str:
    return "concat(" + ", ".join(_quote(p) if isinstance(p, str) else f"{_quote(p['prefix'])}, {p['column']}, {_quote(p['suffix'])}"
                                 for p in template["template"]) + ")"


ROW_PROMPTS = _with(ARTICLES, ("steps", f"""SELECT *, cast(s AS INTEGER) AS step_no
  FROM (SELECT *, unnest(range(0, 18)) AS s FROM articles) WHERE s <= {fx.K}"""), body=f"""
SELECT doc_id, step_no, md5(CASE step_no WHEN 0 THEN {_template_prompt(templates.MASK_TEMPLATE)}
  WHEN 1 THEN {_template_prompt(templates.PARA_TEMPLATE)}
  ELSE CASE WHEN step_no % 2 = 0 THEN {_template_prompt(templates.MASK_TEMPLATE_ITER)}
    ELSE {_template_prompt(templates.PARA_TEMPLATE_ITER)} END END) AS text FROM steps""")

SQL = {
    "ladder_replay": _ladder("mp"),
    "ladder_replay_paused": _with(*_finished("mp", 8), body="""SELECT doc_id, neutered_text, neutered_at_step,
      4 AS pending FROM done WHERE s <= 3"""),
    "sentiment_replay": _with(ARTICLES, body="""SELECT doc_id, cast(doc_id % 5 AS varchar) AS direction_neut,
      cast(concat('0.', doc_id % 5) AS DOUBLE) AS magnitude_neut, cast(doc_id % 3 AS varchar) AS direction,
      cast(concat('0.', doc_id % 3) AS DOUBLE) AS magnitude FROM articles"""),
    "sentiment_requests": _with(ARTICLES, body=f"""SELECT doc_id, 'raw' AS target, to_json(struct_pack(
      model := 'gpt-4o-mini', messages := [struct_pack(role := 'system', content := {_quote(templates.SENTIMENT_PROMPT)}),
        struct_pack(role := 'user', content := body)], top_p := 1, frequency_penalty := 0,
      presence_penalty := 0, logprobs := false, temperature := 0, max_tokens := 16384))::varchar AS request
      FROM articles"""),
    "row_prompts": ROW_PROMPTS,
    "token_sort": """SELECT doc_id, md5(array_to_string(list_sort(list_filter(string_split(
      regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> '')), ' ')) AS sorted_md5 FROM documents""",
    "profile": _with(ARTICLES, body="""SELECT count(DISTINCT comnam) AS firms, count(DISTINCT ticker) AS tickers,
      count(DISTINCT industry) AS industries, min(pub_date) AS earliest, max(pub_date) AS latest FROM articles"""),
    "clean_chars": """SELECT doc_id, replace(replace(replace(replace(text, chr(10), ''), '''', ''), '*', ''), chr(92), '')
      AS cleaned, cast(length(text) AS INTEGER) AS chars FROM documents""",
    "prompt_mask": _prompt(templates.MASK_TEMPLATE),
    "prompt_mask_iter": _prompt(templates.MASK_TEMPLATE_ITER),
    "prompt_paraphrase": _prompt(templates.PARA_TEMPLATE),
    "prompt_paraphrase_iter": _prompt(templates.PARA_TEMPLATE_ITER),
    "extract_identification": _with(ARTICLES, ("answers", fx.MESSY_GUESSES), GUESSED, body="SELECT * FROM guessed"),
    "extract_sentiment": _with(
        ARTICLES, ("answers", fx.MESSY_SENTIMENT),
        ("read_", f"""SELECT doc_id, {_sentiment(DIRECTION)} AS direction, {_sentiment(MAGNITUDE)} AS m
          FROM (SELECT doc_id, {PLAIN} AS plain FROM answers)"""),
        body="SELECT doc_id, direction, try_cast(m AS DOUBLE) AS magnitude FROM read_"),
    "clean_name": _with(ARTICLES, body=f"""SELECT doc_id, comnam, {_clean('comnam')} AS cleaned,
      {_clean("concat('Star ', comnam, ' (The) S.A.')")} AS with_noise,
      {_clean("concat('Star ', comnam, ' (The) S.A.')", FORMS.replace('.', chr(92) + '.'))} AS with_noise_escaped
      FROM articles"""),
    "name_similarity": NAME_SIMILARITY,
    "name_similarity_by_pair": NAME_SIMILARITY_BY_PAIR,
    "date_match": DATE_MATCH,
    "check_identified": CHECK_IDENTIFIED,
    "ladder_full": _ladder("mp"),
    "ladder_mask_only": _ladder("m"),
    "ladder_para_only": _ladder("p"),
    "ladder_no_rounds": _ladder("mp", 0),
    "ladder_none": _with(ARTICLES, body=f"""SELECT doc_id, body AS neutered_text, 0 AS neutered_at_round,
      'no_neutering' AS neutered_at_step, {_sentiment_of('body', '')} FROM articles"""),
    "first_neutered_step": _with(*_finished("mp", 8), body="""SELECT doc_id, neutered_at_step AS first_passed_at,
      s + 1 AS attempts FROM done"""),
    "last_guess": _with(*_finished("mp", 8), body="""SELECT doc_id, ticker AS ticker_guess, name_guess,
      strftime(date_guess, '%Y-%m-%d') AS date_guess_raw, industry AS industry_guess,
      cast(s AS INTEGER) AS step_no FROM done"""),
    "summary_by_step": _with(*_finished("mp", 8), body="""SELECT neutered_at_step, count(*) AS texts FROM done
      GROUP BY neutered_at_step ORDER BY texts DESC, neutered_at_step"""),
    "identification_rate": _with(*_finished("mp", 8),
                                 body="SELECT round(100 * avg(identified), 3) AS identification_rate FROM done"),
    "wide_attempts": _wide(),
    "sentiment_both": _with(*_finished("mp", 8), body=f"""SELECT doc_id, identified AS iort_guess_correct_neutered,
      {_sentiment_of('neutered_text', '_neut')}, {_sentiment_of('body', '')} FROM done"""),
    "combine_runs": _with(*_finished("mp", 8), body=f"""
      SELECT '007' AS run_id, doc_id, neutered_at_step, identified AS iort_guess_correct_neutered,
        {_sentiment_of('body', '')} FROM done
      UNION ALL BY NAME
      SELECT '7' AS run_id, doc_id, neutered_at_step, identified AS iort_guess_correct_neutered FROM done"""),
    "combine_csv": _with(ARTICLES, body="""
      SELECT cast(doc_id AS varchar) AS doc_id, ticker FROM articles WHERE doc_id % 2 = 0
      UNION ALL BY NAME SELECT industry, cast(doc_id AS varchar) AS doc_id FROM articles WHERE doc_id % 2 = 1"""),
    "replay_join": REPLAY,
    "replay_by_content": """SELECT doc_id, concat('seen first in ', min(doc_id) OVER (PARTITION BY text)) AS text
      FROM documents""",
    "callable_responder": """SELECT doc_id,
      CASE WHEN lang = 'fr' THEN '' ELSE concat(length(text), ' ', md5(text)) END AS text,
      CASE WHEN lang = 'fr' THEN 'error' ELSE 'ok' END AS status,
      CASE WHEN lang = 'fr' THEN 'no French' END AS message FROM documents""",
    "error_table": ERRORS,
    "rule_mask": _with(ARTICLES, body=_rule_mask(SPELLINGS)),
    "rule_mask_lettered": _with(("articles", fx.ARTICLES), ("spelled", f"SELECT doc_id, {WRITTEN} AS body FROM articles"),
                                ("masked", _lettered("body", "spelled")), body="SELECT doc_id, masked FROM masked"),
    "rule_mask_words": _with(ARTICLES, body=f"""SELECT doc_id, t AS masked FROM ({_mask_patterns(
        'body', f"(SELECT doc_id, {WRITTEN} AS body FROM articles)", 'doc_id')})"""),
    "rule_mask_texts": f"""SELECT origin, doc_id, turn, t AS masked FROM ({_mask_patterns('text', """(
      SELECT 'documents' AS origin, doc_id, 0::BIGINT AS turn, text FROM documents UNION ALL
      SELECT 'conversations', conv_id, turn, text FROM conversations)""", 'origin, doc_id, turn')})""",
    "ladder_with_rules": _with(ARTICLES, body=f"""SELECT doc_id, masked AS neutered_text,
      'masking_step_0' AS neutered_at_step, 0 AS iort_guess_correct_neutered FROM ({_rule_mask('body')})"""),
    "entity_mask": ENTITY_MASK,
    "entity_mask_joined": ENTITY_MASK,
    "entity_mask_large": ENTITY_MASK,
    "robustness_by_model": _with(ARTICLES, ("robust", ROBUST), body="""SELECT model, count(*) AS texts,
      round(100 * avg(cast(right_ AS INTEGER)), 3) AS identification_rate FROM robust GROUP BY model"""),
    "robustness_wide": _with(ARTICLES, ("robust", ROBUST), ("guessed_", f"""
      SELECT model, doc_id, CASE WHEN blank THEN 'NA' WHEN right_ AND doc_id % 2 = 0 THEN comnam
        ELSE '{fx.WRONG_NAME}' END AS n,
        CASE WHEN blank THEN 'NA' WHEN right_ AND doc_id % 2 = 1 THEN strftime(pub_date, '%Y-%m-%d')
        ELSE '{fx.WRONG_DATE}' END AS d FROM robust"""), body="""
      SELECT doc_id, max(n) FILTER (model = 'llama3.2') AS name_guess_llama,
        max(n) FILTER (model = 'gemma3:4b') AS name_guess_gemma,
        max(d) FILTER (model = 'llama3.2') AS date_guess_llama,
        max(d) FILTER (model = 'gemma3:4b') AS date_guess_gemma FROM guessed_ GROUP BY doc_id"""),
    "token_budget": _with(("words", WORDS), body="""SELECT doc_id, word_count, cast(word_count * 2 AS BIGINT) AS tokens,
      CASE WHEN word_count = 0 THEN 'empty' WHEN word_count * 2 > 120000 THEN 'too_big' ELSE 'send' END AS route,
      cast(floor(word_count * 1.45::DOUBLE) AS BIGINT) AS rough_tokens FROM words"""),
    "batch_by_name": _with(("words", WORDS), ("last_", LAST), body=f"""SELECT name,
      CASE WHEN word_count = 0 THEN {_quote(EMPTY_ANSWER)} ELSE concat('read ', doc_id) END AS response,
      CASE WHEN word_count = 0 THEN 'empty' ELSE 'ok' END AS status FROM last_"""),
    "batch_too_big": _with(("words", WORDS), body="""SELECT name, doc_id, word_count,
      cast(word_count * 2 AS BIGINT) AS tokens FROM words WHERE word_count * 2 > 120000"""),
    "batch_exploded": _with(("words", WORDS), ("last_", LAST), ("lines", f"""SELECT name,
      CASE WHEN word_count = 0 THEN 'empty' ELSE 'ok' END AS status, string_split(
        CASE WHEN word_count = 0 THEN {_quote(EMPTY_ANSWER)} ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END,
        chr(10)) AS l FROM last_"""), body="""
      SELECT name, status, cast(i AS INTEGER) AS line_no, l[i + 1] AS line
      FROM (SELECT *, unnest(range(0, len(l))) AS i FROM lines)"""),
    "batch_header": _with(("words", WORDS), body="""SELECT doc_id, name, word_count FROM words
      ORDER BY doc_id LIMIT 100"""),
    "rolling_tokens": """
      WITH log AS (SELECT user_id AS client, ts, cast(floor(value * 2) AS INTEGER) AS tokens FROM events),
      instant AS (SELECT client, ts, count(*) AS requests, sum(tokens) AS tokens FROM log GROUP BY client, ts),
      rolled AS (SELECT *, sum(tokens) OVER (PARTITION BY client ORDER BY ts
        RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS rolling FROM instant)
      SELECT client, ts, requests, cast(tokens AS BIGINT) AS tokens, cast(rolling AS BIGINT) AS rolling_tokens,
        CASE WHEN rolling >= 100 THEN 1 ELSE 0 END AS over_budget FROM rolled""",
    "rolling_tokens_default": """
      WITH log AS (SELECT user_id AS client, ts, cast(floor(value * 2000000) AS BIGINT) AS tokens FROM events),
      instant AS (SELECT client, ts, count(*) AS requests, sum(tokens) AS tokens FROM log GROUP BY client, ts),
      rolled AS (SELECT *, sum(tokens) OVER (PARTITION BY client ORDER BY ts
        RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW) AS rolling FROM instant)
      SELECT client, ts, requests, cast(tokens AS BIGINT) AS tokens, cast(rolling AS BIGINT) AS rolling_tokens,
        CASE WHEN rolling >= 10000000 THEN 1 ELSE 0 END AS over_budget FROM rolled""",
    "send_plan": f"""
      WITH log AS (SELECT event_id, user_id AS client, cast(floor(value * 20) AS INTEGER) AS tokens, epoch_us(ts) AS came FROM events),
      sized AS (SELECT *, CASE WHEN tokens < {PLAN_LIMIT} THEN tokens END AS fit FROM log),
      ran AS (SELECT *, (sum(coalesce(fit, 0)) OVER (PARTITION BY client ORDER BY event_id) - coalesce(fit, 0))::HUGEINT
        * {PLAN_SPAN + 1} // greatest(1, {PLAN_LIMIT - 1} - coalesce(max(fit) OVER (PARTITION BY client), 0)) AS lapsed FROM sized)
      SELECT event_id, client, tokens, came, CASE WHEN fit IS NOT NULL THEN (lapsed + max(CASE WHEN fit IS NOT NULL THEN came - lapsed END)
        OVER (PARTITION BY client ORDER BY event_id))::BIGINT END AS release FROM ran""",
    "request_payload": _with(ARTICLES, ("named", """SELECT *, CASE WHEN doc_id % 2 = 0
      THEN 'gpt-5-nano-2025-08-07' ELSE 'gpt-4o-mini' END AS m FROM articles"""), body=f"""
      SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_request('max_completion_tokens := 16384')}
        ELSE {_request('temperature := 0, max_tokens := 16384')} END AS request FROM named"""),
    "request_payload_local": _with(ARTICLES, body=f"""SELECT doc_id, to_json(struct_pack(model := 'gemma3:4b',
      messages := [struct_pack(role := 'system', content := concat({_MASK_PROMPT})),
        struct_pack(role := 'user', content := body)],
      options := struct_pack(temperature := 0, top_p := 1, presence_penalty := 0, frequency_penalty := 0,
        max_tokens := 16384, reset := true)))::varchar AS request FROM articles"""),
    "csv_round_trip": _with(ARTICLES, body="SELECT doc_id, body, comnam, ticker, industry, pub_date FROM articles"),
    "csv_one_big_file": _with(ARTICLES, body="SELECT doc_id, body, comnam, ticker, industry, pub_date FROM articles"),
    "csv_reordered": _with(ARTICLES, body="""SELECT doc_id, body, comnam, ticker, industry, pub_date,
      CASE WHEN doc_id % 2 = 1 THEN 'late' END AS desk FROM articles"""),
    "mixed_dates": _with(ARTICLES, body=f"""SELECT doc_id, pub_date + to_microseconds(CASE doc_id % {len(SPELLED_DATES)} {
        ' '.join(f'WHEN {i} THEN {us}' for i, (_, us) in enumerate(SPELLED_DATES))} END) AS pub_date FROM articles"""),
    "batch_job": _with(*_finished("mp", 8), body="""
      SELECT 'firms' AS fact, cast(count(DISTINCT comnam) AS DOUBLE) AS value FROM done
      UNION ALL SELECT 'industries', count(DISTINCT industry) FROM done
      UNION ALL SELECT 'identification_rate', round(100 * avg(identified), 3) FROM done
      UNION ALL SELECT neutered_at_step, count(*) FROM done GROUP BY neutered_at_step
      UNION ALL SELECT 'bullish', count(*) FILTER (length(body) % 2 = 1) FROM done"""),
    "offline_requests": _with(ARTICLES, body=f"""SELECT doc_id, 1 AS step_no, to_json(struct_pack(
      model := 'gpt-4o-mini', messages := [struct_pack(role := 'system', content := {_quote(templates.GUESS_PROMPT)}),
        struct_pack(role := 'user', content := body)], top_p := 1, frequency_penalty := 0,
      presence_penalty := 0, logprobs := false, temperature := 0, max_tokens := 16384))::varchar AS request
      FROM articles"""),
    "wrapped_responder": """SELECT doc_id, regexp_replace(replace(replace(replace(replace(
      text, chr(10), ''), chr(39), ''), '*', ''), chr(92), ''), '\\s+$', '') AS text FROM documents""",
    "stable_sample_half": """SELECT doc_id, text FROM documents
      QUALIFY row_number() OVER (ORDER BY md5(concat('7:', doc_id))) <= (SELECT count(*) // 2 FROM documents)""",
    "profile_runs": _with(ARTICLES, body="""SELECT (doc_id % 4)::INTEGER AS run, count(*) AS texts, min(pub_date) AS earliest, max(pub_date) AS latest,
      true AS firms_near, true AS tickers_near, true AS industries_near FROM articles GROUP BY 1
      UNION ALL SELECT -1, count(*), min(pub_date), max(pub_date), true, true, true FROM articles"""),
    "paused_run": _with(*_finished("mp", 8), body="""SELECT 'identification_rate' AS fact, NULL::DOUBLE AS value
      UNION ALL SELECT neutered_at_step, count(*)::DOUBLE FROM done WHERE s <= 3 GROUP BY 1
      UNION ALL SELECT 'waiting', count(*)::DOUBLE FROM done WHERE s > 3
      UNION ALL SELECT 'waiting guess 4', count(*)::DOUBLE FROM done WHERE s > 3"""),
    "ladder_late_answers": _ladder("mp"),
    "extra_columns": _with(*_finished("m", 8), body="""SELECT done.doc_id, lang, source AS desk, n_chars AS round_input, neutered_at_step,
      concat('Mask for desk ', CASE WHEN source IS NULL THEN 'nan' WHEN source = '' THEN 'N/A' ELSE source END, ', in ',
        CASE WHEN lang IS NULL THEN 'nan' WHEN lang = '' THEN 'N/A' ELSE lang END, '. ', s) AS neutered_text
      FROM done JOIN documents USING (doc_id)"""),
    "stable_sample": _with(ARTICLES, body="""SELECT doc_id, comnam, body FROM articles
      ORDER BY md5(concat('7:', doc_id)) LIMIT 50"""),
}
