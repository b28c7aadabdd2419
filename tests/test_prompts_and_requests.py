import json
import warnings

import pytest
from pyspark.sql import functions as F

from anontext.operators import templates
from anontext.operators.requests import build_requests, hosted_request


def _prompt(spark, template, row="'Blue Bolt' AS comnam, '' AS ticker, CAST(NULL AS STRING) AS industry"):
    df = spark.sql(f"SELECT {row}")
    return df.select(templates.compile_prompt(template, df.columns).alias("p")).first().p


def test_cells_of_a_template(spark):
    template = {"template": ["A ", {"column": "comnam", "prefix": "<", "suffix": ">"}, {"column": "ticker"},
                             {"column": "industry", "suffix": "."}, " Z"]}
    assert _prompt(spark, template) == "A <Blue Bolt>N/Anan. Z"


def test_source_names_stand_for_ours(spark):
    template = {"template": [{"column": "COMNAM"}, {"column": "Companies"}, {"column": "SIC_Industry", "prefix": " "}]}
    assert _prompt(spark, template) == "Blue BoltN/A nan"


def test_unknown_parts_are_left_out_with_a_warning(spark):
    template = {"template": ["A", {"column": "nope", "prefix": "<", "suffix": ">"}, 7, "Z"]}
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert _prompt(spark, template) == "AZ"
    assert len([w for w in seen if "prompt" in str(w.message)]) == 2


def test_a_dict_without_template_is_refused():
    with pytest.raises(ValueError):
        templates.compile_prompt({"text": "x"}, [])


def test_a_string_is_sent_as_it_is(spark):
    assert _prompt(spark, templates.GUESS_PROMPT) == templates.GUESS_PROMPT


def test_own_templates_name_the_three_columns(spark):
    for t in (templates.MASK_TEMPLATE, templates.MASK_TEMPLATE_ITER, templates.PARA_TEMPLATE, templates.PARA_TEMPLATE_ITER):
        assert [p["column"] for p in t["template"] if isinstance(p, dict)] == ["comnam", "ticker", "industry"]
    assert templates.MASK_TEMPLATE != templates.MASK_TEMPLATE_ITER


@pytest.mark.parametrize("model, has, lacks", [
    ("gpt-4o-mini", {"temperature": 0, "max_tokens": 16384}, {"max_completion_tokens", "top_logprobs"}),
    ("GPT-5-nano", {"max_completion_tokens": 16384}, {"temperature", "max_tokens", "top_logprobs"}),
    ("my-gpt-5", {"max_completion_tokens": 16384}, {"temperature", "max_tokens"}),
    ("xgpt-5", {"temperature": 0}, {"max_completion_tokens"}),
])
def test_hosted_requests(spark, model, has, lacks):
    df = spark.range(1).select(hosted_request(F.lit("s"), F.lit("u\n\"é"), model).alias("r"))
    made = json.loads(df.first().r)
    assert has.items() <= made.items() and not lacks & made.keys()
    assert made["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": "u\n\"é"}]
    assert made["top_p"] == 1 and made["logprobs"] is False


def test_local_requests(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"))
    row = build_requests(df, F.lit("s"), F.lit("u"), "llama3.2", "Ollama", temperature=0.5).first()
    made = json.loads(row.request)
    assert made["options"] == {"temperature": 0.5, "top_p": 1, "presence_penalty": 0, "frequency_penalty": 0,
                               "max_tokens": 16384, "reset": True}
