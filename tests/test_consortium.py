import pytest

from jangbu.operators import consortium, policy

CASES = [
    ("공동수급 허용", (False, True), "allowed_explicit", "allow"),
    ("공동수급체 구성은 3개사 이내로 허용한다", (False, True), "allowed_explicit", "allow"),
    ("컨소시엄 불허", (False, False), "forbidden_all", "deny"),
    ("공동수급을 허용하지 않음", (False, False), "forbidden_all", "deny"),
    ("하도급 불허 / 공동수급 허용", (False, True), "allowed_explicit", "allow"),
    ("공동수급 및 하도급은 금지한다", (False, False), "forbidden_all", "deny"),
    ("공동수급체를 반드시 구성하여야 한다", (True, True), "required_all", "allow"),
    ("단독 입찰 불가, 컨소시엄 필수", (True, True), "required_all", "allow"),
    ("공동수급은 의무가 아니며 단독으로도 참여 가능합니다", (False, None), "undetermined", ""),
    ("공동수급(공동이행방식)은 허용하지 않음", (None, None), "method_restricted", ""),
    ("공동수급(공동이행, 분담이행)은 허용하지 않음", (False, False), "forbidden_all", "deny"),
    ("하도급은 금지한다", (None, None), "undetermined", ""),
    ("구성원의 최소 지분율은 10%로 한다", (None, None), "undetermined", ""),
    ("공동수급 구성원은 5개사 이내로 한다", (None, None), "undetermined", "constraint"),
    ("", (None, None), "undetermined", ""),
]


@pytest.mark.parametrize(("text", "both", "state", "kind"), CASES)
def test_readings(text, both, state, kind):
    assert consortium.classify(text)[:2] == both
    assert policy.state_of("value_present", text) == state
    assert policy.policy_kind(text) == kind


def test_states_without_value():
    assert policy.state_of("field_absent", "공동수급 허용") == "field_absent"
    assert policy.state_of("conflict", "공동수급 허용") == "undetermined"
    assert policy.state_of("value_present", "(공동이행방식)", "공동수급은 불허한다") == "forbidden_all"


def test_clash_and_columns(spark):
    assert consortium.classify("공동수급 허용. 공동수급 불허") == (None, None, "both") or consortium.classify("공동수급 허용. 공동수급 불허")[1] is None
    df = spark.createDataFrame([("value_present", "공동수급 허용"), ("value_present", None), (None, "공동수급 불허")], "status string, text string")
    got = df.select(consortium.classified("text").alias("c"), policy.consortium_state("status", "text").alias("s"), policy.consortium_policy("text").alias("p")).collect()
    assert [(r.c.allowed, r.s, r.p) for r in got] == [(True, "allowed_explicit", "allow"), (None, "undetermined", ""), (False, "undetermined", "deny")]
