from fleetgauge.session import READ_BYTES, configure
from fleetgauge.sources.runs import result_documents
from tests.test_runs import fleet_of_runs, results_table


def test_findings_move_once(spark):
    runs, results = fleet_of_runs(spark)
    plan = result_documents(runs, results)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("collect_list")[0]
    assert "Join" not in above and plan.count("RepartitionByExpression") == 1


def test_repeated_and_missing_ids(spark):
    runs, _ = fleet_of_runs(spark)
    done = runs.filter("task_id = '1'")
    odd = done.unionByName(done).unionByName(done.selectExpr("CAST(NULL AS string) AS task_id", *[c for c in done.columns if c != "task_id"]))
    results = results_table(spark, *[("1", "data_skew", "WARNING", i, f"t{i}") for i in (2, 0, 1)], ("9", "data_skew", "INFO", 1, "of no run"))
    nobody = results.filter("task_id = '1'").selectExpr("CAST(NULL AS string) AS task_id", *[c for c in results.columns if c != "task_id"])
    rows = result_documents(odd, results.unionByName(nobody)).collect()
    assert sorted((r.task_id or "", r.part, len(r.rule_results or []), r.result_json is None) for r in rows) == [
        ("", 0, 0, True), ("1", 0, 3, False), ("1", 0, 3, False),
    ]
    assert [f.title for r in rows if r.task_id for f in r.rule_results] == ["t0", "t1", "t2"] * 2


def test_a_task_reads_little_unless_the_caller_says_otherwise(spark):
    own = spark.newSession()
    configure(own)
    assert all(own.conf.get(key) == value for key, value in READ_BYTES.items())
    for key in READ_BYTES:
        own.conf.set(key, "1g")
    configure(own)
    assert all(own.conf.get(key) == "1g" for key in READ_BYTES)
