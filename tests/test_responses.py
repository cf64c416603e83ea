import json

import pytest

from facetframe.operators import responses as L

GOOD = {"executive_summary": " All fine. ", "warnings": ["few rows", 3, None],
        "insights": [{"title": "T", "importance": "high", "category": "Risk", "affected_columns": "age",
                      "evidence": {"n": 3}, "caveats": "none known"}, "skip me", {"evidence": "text"}],
        "recommendations": [{"priority": "HIGH", "supporting_evidence": ["a", 1]}]}


def parse(spark, text):
    return L.parse_responses(spark.createDataFrame([(1, text)], "id int, response string"))


@pytest.mark.parametrize("wrap", ["{}", "```json\n{}\n```", "```\n{}\n```", "Sure: {} - done"])
def test_good_answers(spark, wrap):
    parsed = parse(spark, wrap.replace("{}", json.dumps(GOOD)))
    row = parsed.first()
    assert (row.executive_summary, row.error) == ("All fine.", None)
    first, second = sorted(L.insights(parsed).collect(), key=lambda r: r.insight_id)
    assert (first.insight_id, first.importance, first.category, first.affected_columns) == ("INSIGHT_01", "HIGH", "risk", ["age"])
    assert (first.summary, first.explanation, first.caveats) == ("T", "T", "none known")
    assert json.loads(first.evidence) == {"n": 3}
    assert (second.insight_id, second.title) == ("INSIGHT_03", "Untitled Insight")
    assert json.loads(second.evidence) == {"raw_evidence": "text"}
    advice = L.recommendations(parsed).first()
    assert (advice.recommendation_id, advice.priority, advice.supporting_evidence) == ("REC_01", "high", ["a", "1"])
    assert sorted(r.warning for r in L.warnings(parsed).collect()) == ["3", "None", "few rows"]


@pytest.mark.parametrize("text, error", [
    (None, "empty"), ("  ", "empty"), ('{"executive_summary": ', "JSON"), ("[1, 2]", "object"), ("{}", "missing"),
    ('{"executive_summary": "  "}', "blank"), ('{"executive_summary": "x", "insights": "no"}', "insights"),
    ('{"executive_summary": "x", "recommendations": {}}', "recommendations")])
def test_bad_answers_keep_their_row(spark, text, error):
    parsed = parse(spark, text)
    row = L.failed_responses(parsed).first()
    assert row.id == 1 and error in row.error
    assert L.insights(parsed).count() == 0


def test_minimal_answer(spark):
    parsed = parse(spark, '{"executive_summary": "x"}')
    assert parsed.first().error is None
    assert L.insights(parsed).count() == 0 and L.warnings(parsed).count() == 0
