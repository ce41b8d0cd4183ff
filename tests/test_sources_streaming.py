"""Sources, sinks and the streaming ingest, round-tripped through files
derived from the test tables."""

from pyspark.sql import functions as F

from tests import inspect_plans as inspect
from stakeperf.operators import scores as S
from stakeperf.session import scratch_path
from stakeperf.sources import files as IO
from stakeperf.sources import fixtures as FX
from stakeperf.streaming import score_ingest_query
from tests.compare import digest


def rows(df):
    return digest(df.columns, [tuple(r) for r in df.collect()])[0]


def test_nested_json_source_roundtrip(spark, sf_small):
    nested = FX.fx_nested(spark, sf_small)
    path = scratch_path(spark, "nested-json")
    nested.write.mode("overwrite").json(path)
    back = IO.read_nested_scores(spark, path)
    assert rows(S.flatten_scores(back).drop("rec_pos")) == rows(S.flatten_scores(nested).drop("rec_pos"))


def test_scan_models_prunes_partitions(spark, sf_small):
    root = scratch_path(spark, "staked")
    IO.write_per_model(FX.fx_scores(spark, sf_small), root, "csv")
    df = IO.scan_models(spark, root).where(F.col("model_name") == "m3")
    plan = inspect.plan_text(df, "simple")
    assert "PartitionFilters: [isnotnull(model_name" in plan
    assert df.count() == FX.fx_scores(spark, sf_small).where("model_name = 'm3'").count()


def test_streaming_ingest_matches_batch(spark, sf_small):
    nested = FX.fx_nested(spark, sf_small)
    src = scratch_path(spark, "responses")
    # responses arrive as several files
    nested.repartition(4, "roundNumber").write.mode("overwrite").json(src)
    sink = scratch_path(spark, "ingested")
    ckpt = scratch_path(spark, "ingest-ckpt")
    q = score_ingest_query(spark, src, sink, checkpoint=ckpt, max_files_per_trigger=2)
    q.awaitTermination(300)
    assert q.exception() is None
    want = S.filter_scores(S.flatten_scores(IO.read_nested_scores(spark, src))).drop("rec_pos")
    got = spark.read.parquet(sink).select(*want.columns)
    assert rows(got) == rows(want)
    # a restart over the same folder and checkpoint adds nothing (exactly once)
    n = got.count()
    q2 = score_ingest_query(spark, src, sink, checkpoint=ckpt)
    q2.awaitTermination(300)
    assert spark.read.parquet(sink).count() == n


def test_scan_model_files_flat_layout(spark, tmp_path):
    # one CSV per model, named after the model, as the source writes them
    header = "roundNumber,seq,displayName,date,day,payoutPending,atRisk\n"
    (tmp_path / "v1a.csv").write_text(header + '1,1,"mmc","2024-01-02 00:00:00","1",3.5,10\n'
                                               '1,2,"fnc_v4","2024-01-03 00:00:00","NA",NA,10\n')
    (tmp_path / "glb.csv").write_text(header + '7,1,"mmc","2024-01-05 00:00:00","2",1,4\n')
    df = IO.scan_model_files(spark, str(tmp_path))
    got = sorted((r.model_name, r.seq, r.day, r.payoutPending) for r in df.collect())
    assert got == [("glb", 1, "2", 1.0), ("v1a", 1, "1", 3.5), ("v1a", 2, None, None)]


def test_read_responses_document_per_model(spark, tmp_path):
    import json
    doc = {"data": {"v2RoundModelPerformances": [
        {"roundNumber": 500, "atRisk": 12.5, "intraRoundSubmissionScores": [
            {"date": "2024-01-02T00:00:00Z", "day": 1, "displayName": "mmc", "payoutPending": 0.5,
             "payoutSettled": 0.0, "percentile": 0.4, "value": 0.01},
            {"date": "2024-01-02T00:00:00Z", "day": 1, "displayName": "fnc_v4", "payoutPending": 0.7,
             "payoutSettled": 0.0, "percentile": 0.6, "value": 0.02}]},
        {"roundNumber": 501, "atRisk": 13.0, "intraRoundSubmissionScores": None}]}}
    (tmp_path / "v1a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "glb.json").write_text(json.dumps({"data": {"v2RoundModelPerformances": []}}))
    recs = IO.read_responses(spark, str(tmp_path))
    assert sorted((r.model_name, r.roundNumber) for r in recs.collect()) == [("v1a", 500), ("v1a", 501)]
    flat = S.filter_scores(S.flatten_scores(recs)).collect()
    assert sorted(r.displayName for r in flat) == ["fnc_v4", "mmc"]


def test_scan_models_keeps_numeric_looking_names_as_text(spark, tmp_path):
    d = tmp_path / "model_name=007"
    d.mkdir()
    (d / "part.csv").write_text("roundNumber,seq,displayName,date,day,payoutPending,atRisk\n1,1,mmc,,1,2.5,3\n")
    r = IO.scan_models(spark, str(tmp_path)).collect()[0]
    assert r["model_name"] == "007" and r["payoutPending"] == 2.5
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"


def test_streaming_ingest_of_response_documents(spark, tmp_path):
    import json

    src = tmp_path / "responses"
    src.mkdir()
    for model, rounds in (("m1", [1, 2]), ("m2", [7])):
        doc = {"data": {"v2RoundModelPerformances": [
            {"roundNumber": r, "atRisk": 1.0, "intraRoundSubmissionScores": [
                {"date": "2024-01-02", "day": 1, "displayName": "mmc", "payoutPending": 0.5,
                 "payoutSettled": 0.0, "percentile": 0.1, "value": 0.2},
                {"date": "2024-01-02", "day": 1, "displayName": "other", "payoutPending": 0.5,
                 "payoutSettled": 0.0, "percentile": 0.1, "value": 0.2}]} for r in rounds]}}
        (src / f"{model}.json").write_text(json.dumps(doc, indent=1))
    sink = scratch_path(spark, "ingested-docs")
    q = score_ingest_query(spark, str(src), sink, checkpoint=scratch_path(spark, "ckpt-docs"), documents=True)
    q.awaitTermination(300)
    got = sorted((r.model_name, r.roundNumber) for r in spark.read.parquet(sink).collect())
    assert got == [("m1", 1), ("m1", 2), ("m2", 7)]
