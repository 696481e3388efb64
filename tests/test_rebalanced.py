"""Deduplication sorts what an advised partition holds, whatever the files of the input."""

from netvigil.operators import detect
from netvigil.plans import adapters as a

SF_DIR = "/root/testdata/sf0.001"


def test_input_is_dealt_anew_before_the_detections_are_sorted(spark):
    plan = a.unique_detections(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RebalancePartitions") == 2
    narrow = [line for line in plan.splitlines() if "Exchange" in line or "RebalancePartitions" in line]
    assert all("flow_id" not in line for line in narrow)


def test_the_unique_detections_are_those_of_the_files_order(spark):
    plain = detect.dedup(a.kept_detections(spark, SF_DIR))
    dealt = a.unique_detections(spark, SF_DIR)
    assert dealt.count() and sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))
