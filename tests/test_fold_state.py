"""The state of a fold is not cast with each op."""

from pyspark.sql import functions as F

from threadloom.operators import op_fold as P


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_the_fold_casts_its_state_once(spark):
    row = f"struct<fields:array<{P.FIELD}>,form:map<string,string>,buttons:array<{P.BUTTON}>,ops:array<{P.OP}>>"
    forms = spark.range(1).select("id", F.from_json(F.lit("{}"), row).alias("r")).select("id", "r.*")
    assert plan(P.apply_ops(forms)).count("as struct<fields:") == 1
