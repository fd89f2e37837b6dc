"""Templates against what they must say, and pipelines that are killed between and within steps."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import templates as P
from threadloom.operators import steps as S


@pytest.fixture(scope="module")
def rows(spark):
    row = ('a "b", c: d', True, 3, 1.5, None, {"x": {"y": ["p", 'q, "r": s']}}, [{"k": 1, "in": ["u", "v"]}, {"k": 2, "in": []}], [])
    return spark.createDataFrame([row], "s string, yes boolean, n int, d double, none string, o struct<x:struct<y:array<string>>>, l array<struct<k:int,in:array<string>>>, e array<string>")


CASES = {
    "plain {x} % text\n": "plain {x} % text",
    "{{ s }}|{{n}}|{{ d }}|{{ yes }}|{{ none }}": 'a "b", c: d|3|1.5|True|None',
    "{{ s | tojson }} {{ o|tojson }} {{ n | tojson }} {{ none | tojson }} {{ e | tojson }}": f"{json.dumps('a \"b\", c: d')} {json.dumps({'x': {'y': ['p', 'q, \"r\": s']}})} 3 null []",
    "{% if yes %}1{% else %}2{% endif %}{% if none %}3{% endif %}{% if not e %}4{% endif %}{% if n %}5{% endif %}{% if l %}6{% endif %}": "1456",
    "a\n{%- if yes -%}\n  b\n{%- endif %}\nc": "ab\nc",
    "{% for x in l %}{{ loop.index }}:{{ x.k }}({% for y in x.in %}{{ y }}{{ x.k }}{% if yes %},{% endif %}{% endfor %}){% endfor %}": "1:1(u1,v1,)2:2()",
    "{% for x in o.x.y %}[{{ x }}]{% endfor %}{# gone\n #}{% for x in e %}never{% endfor %}": '[p][q, "r": s]',
    "---\ncacheable: false\n---\n{{ n }}\n\n": "---\ncacheable: false\n---\n3\n",
}


@pytest.mark.parametrize("template", CASES)
def test_templates(rows, template):
    assert rows.select(P.rendered(rows, template).alias("t")).first()["t"] == CASES[template]


@pytest.mark.parametrize("template, error", [("{{ nope }}", KeyError), ("{{ o.z }}", KeyError), ("{{ l }}", TypeError), ("{% for x in s %}{% endfor %}", TypeError), ("{% if s %}", ValueError), ("{% endif %}", ValueError), ("{{ s | upper }}", ValueError), ("{% else %}", ValueError), ("{% for x in l %}{% endif %}", ValueError)])
def test_what_is_wrong_is_told_when_it_is_compiled(rows, template, error):
    with pytest.raises(error):
        P.rendered(rows, template)


def test_static_templates_are_literals_and_only_named_columns_are_read(spark, rows, tmp_path):
    assert P.static("a\n") == "a" and P.static("{{ n }}") is None and P.head("---\ncacheable: false\nn: 3\n---\nx") == {"cacheable": False, "n": 3}
    P.static("---\ncacheable: false\n---\nx")
    assert "---\ncacheable: false\n---\nx" not in P._STATIC and "a\n" in P._STATIC
    rows.write.parquet(str(tmp_path / "t"))
    there = spark.read.parquet(str(tmp_path / "t"))
    plan = there.select(P.assembled(there, ["a"], "{{ n }} {% if yes %}x{% endif %}", append=F.lit(" "))).select("*")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<yes:boolean,n:int>" in plan and "Python" not in plan


def test_assembly(rows):
    say = lambda *a, **k: rows.select(P.assembled(rows, *a, **k).alias("t")).first()["t"]
    assert say(["one", " \n"], "{{ n }}", append=F.lit("last")) == "one\n\n3\n\nlast"
    assert say(["one"], "{{ n }}", override=F.lit("all"), append=F.lit("last")) == "all"
    assert say([], "{{ n }}", override=F.lit(""), append=F.lit("  ")) == "3"
    with pytest.raises(KeyError):
        say(["{{ n }}"], "x")


def make(fail_at, calls):
    def step(name, f):
        def run(df):
            calls.append(name)
            df = f(df)
            return df.withColumn("bad", F.raise_error(F.lit("killed"))) if fail_at == name else df

        return name, run

    return [step("double", lambda d: d.withColumn("v", F.col("v") * 2)), step("ask", lambda d: d.withColumn("question", F.when(F.col("v") > 10, F.concat(F.lit("why "), F.col("v").cast("string"))).otherwise(""))), step("tag", lambda d: d.withColumn("tag", F.concat(F.lit("t"), F.col("v").cast("string"))))]


def test_a_killed_pipeline_goes_on_where_it_was(spark, tmp_path):
    rows = spark.createDataFrame([(k, k) for k in range(10)], "id long, v long")
    whole = sorted(map(tuple, S.run(rows, make(None, []), str(tmp_path / "whole")).collect()))
    assert whole == [(k, 2 * k, f"t{2 * k}") for k in range(6)]
    for name, left in (("double", ["double", "ask", "tag"]), ("ask", ["ask", "tag"]), ("tag", ["tag"])):
        path, calls = str(tmp_path / name), []
        with pytest.raises(Exception, match="killed"):
            S.run(rows, make(name, []), path)
        assert S.finished(spark, path, make(None, [])) == 3 - len(left)
        assert sorted(map(tuple, S.run(rows, make(None, calls), path).collect())) == whole and calls == left
        again = []
        assert sorted(map(tuple, S.run(rows, make(None, again), path).collect())) == whole and again == []
    waiting = S.asked(spark, path, make(None, []), ["id", "v"])
    assert sorted(map(tuple, waiting.collect())) == [(k, 2 * k, f"why {2 * k}", "ask") for k in range(6, 10)]
    answers = spark.createDataFrame([(6, 1), (7, None), (99, 5)], "id long, v long")
    back = S.answered(waiting, answers, "id")
    assert sorted(map(tuple, back.collect())) == [(6, 1), (7, 14)]
    assert sorted(map(tuple, S.run(back, make(None, []), str(tmp_path / "again")).collect())) == [(6, 2, "t2")]


def test_nothing_goes_through(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, v long")
    assert S.run(rows, make(None, []), str(tmp_path / "none")).collect() == [] and S.asked(spark, str(tmp_path / "none"), make(None, []), ["id"]).collect() == []
