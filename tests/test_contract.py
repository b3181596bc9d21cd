"""The declared columns against the published dictionary's rules, and violations against counts by hand."""

from collections import Counter

from zonewise import contract, lookups


def test_declared_columns():
    fields = contract.final_fields()
    names = [f.name for f in fields]
    assert len(names) == len(set(names)) == 176
    kinds = Counter(f.kind for f in fields)
    assert kinds == {"number": 92 + 18, "flag": 45 + 2, "share": 10, "integer": 3, "text": 3, "id": 3}
    stems = {s.lower() for own in lookups.ROUNDS.values() for s in own}
    assert {n.removesuffix("_detectcws") for n in names if n.endswith("_detectcws")} == stems - set(contract.UNFLAGGED)
    assert [f.name for f in fields if f.key] == ["tract_geoid"]


def test_violations(spark):
    rows = [
        ("01001000100", 0.5, 1.0, 3.0, "x"), ("01001000100", 1.5, 2.0, 3.5, "x"), (None, None, None, None, None), ("1", -0.1, 0.0, 2.0, "x"),
    ]
    df = spark.createDataFrame(rows, "tract_geoid string, pov_allage double, dcpa_detectcws double, n_cws_ucmr double, medhhinc string")
    got = {(r.column, r.rule): r.n for r in contract.violations(df.withColumn("extra", df.pov_allage), contract.final_fields(), True).collect()}
    assert got == {
        ("extra", "undeclared"): 1, ("medhhinc", "type"): 1, ("tract_geoid", "malformed"): 1, ("pov_allage", "malformed"): 2,
        ("dcpa_detectcws", "malformed"): 1, ("n_cws_ucmr", "malformed"): 1, ("tract_geoid", "null"): 1, ("tract_geoid", "repeated"): 2,
    }
    missing = contract.violations(df, contract.final_fields()).where("rule = 'missing'").count()
    assert missing == 176 - 5
    assert contract.violations(df.where("false"), contract.final_fields(), True).where("n > 0 and rule <> 'type'").count() == 0
