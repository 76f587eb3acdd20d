"""One whole JSON array and nothing else."""

import json

import pytest

from shroud.functions.payload import parse_items

CASES = ['[{"text":"a"}]', ' [ {"text":"a"} ] \n', '[{"text":"a"},{"text":"b","category":"c"}]', '[{"text":"a"}] [1]', '[{"text":"a"}][]', "[][]", "[]",
         '[{"text":"a"}],[{"text":"b"}]', '[{"text":"a"}]] [1]', '[{"text":"a"}]} {"y":[1]', '[{"text":"a"}]}[]', '[{"text":"a"}],"y":[1]', '{"text":"a"}',
         '[{"text":"a"}]x', '[{"text":"a"}', "[{'text':'a'}]", '[{"text":"a","text":"b"}]', '[{"text":"x ] } [ { y"}]', '[{"text":"a\\"]"}]', "", "null", "[null"]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)] + [(-1, None)], "i int, c string")
    return {r.i: r.p for r in df.select("i", parse_items(df["c"]).alias("p")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_as_a_strict_parser(parsed, i):
    try:
        want = json.loads(CASES[i])
    except ValueError:
        want = None
    want = want if isinstance(want, list) and want else None
    got = parsed[i]
    assert (got is None) == (want is None)
    if want:
        assert [x.text for x in got] == [x["text"] for x in want]


def test_null(parsed):
    assert parsed[-1] is None
