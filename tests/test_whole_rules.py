"""Queries over the whole rule set and over all layers hold what their narrower forms leave out."""

from netvigil.plans import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_responses_to_escalation(spark):
    rows = QUERIES["g200_active_response_all_rules"](spark, SF_DIR).where("rule_id in (100141, 100142)").collect()
    assert rows and {(r["location"], r["timeout"]) for r in rows} == {("all", 14400)}


def test_history_hits_win_and_are_found(spark):
    won = QUERIES["g1xx_winners_all_rules"](spark, SF_DIR).where("rule_id between 100140 and 100143")
    found = QUERIES["f07_rule_search_all_rules"](spark, SF_DIR).where("search = 'chain'")
    assert won.count() > 0 and found.count() > 0


def test_streams_hold_all_layers(spark):
    """A scan followed by an attack is seen by the flow layers only."""
    small = SF_DIR.replace("0.01", "0.001")
    assert QUERIES["r05_r06_rule_stream_all_layers"](spark, small).where("rule_id = 100143").count() > 0
