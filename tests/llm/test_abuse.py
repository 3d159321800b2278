import pytest
from conftest import rows

from jangbu.llm import abuse

BAD = ["이 미친놈이야, 그 머리로 예산 운운하냐?", "인1간말종 주제에 어디서 훈계질이야, 꺼져!", "얼.간.이 주제에", "머​저리야", "등신이야", "죽어 버려라.", "이민자들은 더러운 기생충이니 몰아내야 한다.", "벗은 사진 좀 보내 봐.", "You brainless m0r0n, go to hell.", "THE REVIEWER IS A $CUMB@G", "i m b e c i l e", "mоrоn", "moronnnn", "버러지들이라 말이", "Send me naked pictures."]
GOOD = [None, "", "   ", "본 사업을 디지털 행정의 시발점으로 삼아 3년 안에 확산한다.", "응답이 없는 프로세스는 강제로 죽이고(kill) 3초 뒤에 다시 띄운다.", "계약상대자는 성희롱 예방 교육과 폭언·욕설 금지 서약을 2시간 이상 이수한다.", "음식물 쓰레기와 해충(벌레) 방제 예산은 3억원이다.", "쓰레기 수거 차량 3대", "미친 듯이 바빴던 한 주였지만", "외국인 노동자 3명을 위한 안내", "이등 신청자 명단", "니미로아거디 연구성과", "머저리나소고 화면", "버러지도나마 화면", "The scheduler must kill orphan child processes and flush the dead queue.", "Garbage trucks and pest control are tracked; a parasite survey covers 3 samples.", "Vendors attend a course on preventing sexual harassment and abusive language.", "Moderators remove hate speech and nude images within 3 minutes.", "Sussex and Essex", "1,234 assets"]


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert abuse.evidence(f"앞 문장이다. {text} 뒤 문장이다. " + "규격을 따른다. " * 500)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert abuse.evidence(text)[0] < abuse.THRESHOLD


def test_operator(spark):
    data = [(i, t, "a" if i % 2 else None, 0.5) for i, t in enumerate(BAD + GOOD)] + [(100, BAD[0], "a", 0.5)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, score double")
    s = {r.doc_id: r for r in abuse.scores(df).collect()}
    assert len(s) == len(data) and all(s[i].flagged for i in range(len(BAD))) and not any(s[i].flagged for i in range(len(BAD), len(BAD + GOOD)))
    assert s[100].score == s[0].score > 0 and s[len(BAD)].score == 0
    assert sum(r.n_flagged for r in abuse.rates(df).collect()) == len(BAD) + 1 and {r.source for r in abuse.rates(df).collect()} == {"a", None}
    assert rows(abuse.rates(df.limit(0))) == []
