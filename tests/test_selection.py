import itertools

import pytest
from conftest import rows

from jangbu.operators import selection
from jangbu.operators.selection import Condition

SCHEMA = "row_id long, document_id string, field_name string, status string, answer_raw string, answer_normalized string, active string, verdict string"


def test_three_values(spark):
    """Every mix of a true, false, unknown and missing cell under two conditions, as Kleene's AND has it."""
    state = {"yes": ("value_present", "500"), "no": ("value_present", "5"), "unknown": ("conflict", "500"), "missing": None}
    region = {"yes": "value_present", "no": "field_absent", "missing": None}
    data, want = [], set()
    for n, (b, r) in enumerate(itertools.product(state, region)):
        if state[b]:
            data.append((len(data), f"d{n}", "예산", *state[b][:1], state[b][1], None, None, "x"))
        if region[r]:
            data.append((len(data), f"d{n}", "지역제한", region[r], None, None, "true", "x"))
        known = {"yes": True, "no": False}
        x, y = known.get(b), known.get(r)
        if x is not False and y is not False and (state[b] or region[r]):
            want.add((f"d{n}", "confirmed" if x and y else "undetermined"))
    df = spark.createDataFrame(data, SCHEMA)
    conditions = [Condition("예산", ">=", 100.0), Condition("지역제한", "absent", negated=True)]
    assert set(rows(selection.verdicts(df, conditions))) == want
    assert selection.verdicts(df, []).count() == 0
    scope = spark.createDataFrame([("d0",), ("d99",)], "document_id string")
    assert rows(selection.verdicts(df, conditions, scope)) == [("d0", "confirmed"), ("d99", "undetermined")]
    assert rows(selection.outcome(selection.verdicts(df.limit(0), conditions))) == [(0, 0, "empty")]


def test_first_active_row_counts(spark):
    data = [(3, "d", "예산", "conflict", "3", None, "true", ""), (1, "d", "예산", "value_present", "1", None, "False", ""), (2, "d", "예산", "value_present", "2", None, None, ""), (4, None, "예산", "conflict", "4", None, None, "")]
    assert [r.row_id for r in selection.current_cells(spark.createDataFrame(data, SCHEMA)).collect()] == [2]


@pytest.mark.parametrize("bad", [("공고일", ">=", 1.0, False), ("예산", "like", None, False), ("예산", ">=", 1.0, True), ("예산", ">=", None, False)])
def test_conditions_are_checked(bad):
    with pytest.raises(ValueError):
        Condition(*bad)
