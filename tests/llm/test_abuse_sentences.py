"""Sentences of our own, written before the lexicon was drawn up: what share of them the general vocabulary finds, and what it leaves alone."""

import pytest

from jangbu.llm import abuse

ABUSIVE = """
야 이 등신아 그것도 일이라고 했냐
저런 골 빈 여자들은 투표권을 뺏어야 해
네 목을 비틀어 버리기 전에 입 다물어
과장님 엉덩이 한번 주물러 보고 싶네요
조선족은 죄다 범죄자 새끼들이다
ㅂㅅ들 모여서 회의한다고 난리네
너 같은 건 세상에 태어나지 말았어야 했어
시ㅂㅏㄹ 진짜 일처리 개판이네
늙은이들은 냄새나니까 밖에 나오지 좀 마라
내일 회사 앞에서 기다렸다가 칼로 쑤셔 줄게
동남아 출신은 미개해서 같이 일 못 한다
오늘 입은 치마 짧아서 좋네, 안에 뭐 입었어?
무식한 촌놈들이 뭘 안다고 떠들어
이 개 쌍놈의 자식아 당장 사과해
대가리에 똥만 찼냐
게이들은 전부 수용소에 처넣어야 한다
니 애미가 그렇게 가르치디
퇴근하고 모텔 가서 한판 뛸래?
찌질한 놈, 그 꼬라지로 무슨 발표냐
전라도 놈들은 뒤통수나 치는 종자들
병1신 같은 담당자 때문에 망했다
장애인은 세금만 축내는 쓸모없는 존재
What a worthless pack of cretins you are
I'm going to stab you in the parking lot
f*ck off you useless clown
Muslims are a disease and must be driven out
Send me a picture of your boobs tonight
this sh1t reviewer is a total m0ron
Old folks are a burden and should be put down
I will burn your house with your kids inside
shut your filthy mouth, you ugly cow
Women are too emotional and stupid to lead a project
go hang yourself, nobody likes you
I bet you look great bent over my desk with nothing on
fuck this committee
Gypsies are thieves, every one of them
You'd better sleep with one eye open
kiss my ass, jerk
the disabled are nothing but a waste of money
you dumb piece of garbage
""".strip().splitlines()

NEUTRAL = """
프로세스를 강제로 죽이고 다시 시작한다
쓰레기 수거 차량 20대를 새로 들인다
해충 방제와 벌레 제거 용역을 발주한다
성희롱 예방 교육을 연 1회 실시한다
욕설이나 비하 발언이 포함된 글은 삭제한다
노인 복지관 쓰레기 처리 예산이 줄었다
장애인 편의시설이 더러워 청소가 필요하다
이 노선의 시발점은 중앙역이다
여성 화장실 몰래카메라 점검을 실시한다
좀비 프로세스를 죽인다
외국인 근로자를 위한 기생충 검사를 한다
담당자님 너무 감사합니다
미처 보지 못한 서류가 있다
잠도 자지 않고 근무한 인력에게 수당을 준다
가슴 엑스선 검사 장비를 구매한다
속옷과 방한복 구매 예산을 반영한다
'병신'이라는 표현은 자동으로 걸러진다
여성과 장애인이 참여하는 사업에 가점을 준다
칼로 자른 단면을 사진으로 제출한다
집 주소를 알려 주시면 서류를 보내 드립니다
놈이라는 글자가 든 지명은 세 곳이다
흥분하지 말고 절차대로 이의를 제기해 주세요
kill the process and restart the job
twelve dumb terminals are replaced
the garbage collector pauses for 20 ms
the sex ratio at birth is reported by region
the master node will kill them after a timeout
breast cancer screening equipment is included
abusive language is prohibited on this board
the parasite survey covers 300 samples
assess the class assignment before the assembly
Women are underrepresented in project leadership
defects must be visible to the naked eye
immigrants are eligible for language support
you are responsible for waste and trash removal
Your proposal is incomplete and will be rejected
""".strip().splitlines()


@pytest.mark.parametrize("limit", [0.8])
def test_recall(limit):
    missed = [s for s in ABUSIVE if not abuse.judged(s).flagged]
    assert len(missed) <= (1 - limit) * len(ABUSIVE), missed


@pytest.mark.parametrize("sentence", NEUTRAL)
def test_neutral(sentence):
    assert not abuse.judged(sentence).flagged


# written after the first lexicon, which found 9 of them; its rules were then widened
LATER = """
그 따위 실력으로 월급 받는 게 창피하지도 않냐, 이 무능한 인간아
확 그냥 모가지 비틀어 버릴라
너네 부서 여직원 다리 라인 예술이더라
베트남 애들은 원래 손버릇이 나빠서 못 믿어
에라이 쓸개 빠진 놈들
니 면상에 커피를 끼얹고 싶다
야 돼지야 살이나 빼고 와라
말귀 못 알아듣는 짐승이냐 너
저 병신들 데리고 일하려니 미치겠다
불 싸지르고 너도 같이 태워 줄까
you people make me sick, bunch of brain-dead sheep
I'd love to see someone break both your legs
Nice rack, wanna show me more after the meeting?
Those migrants breed like rabbits and steal everything
What a dumb b1tch
You're as useful as a bag of rocks, moron
Homosexuals should be locked up for good
get the hell out you lying sack of crap
we'll come for your family, just wait
that hag should be dragged out by her hair
""".strip().splitlines()


def test_recall_on_later_sentences():
    found = sum(abuse.judged(s).flagged for s in LATER)
    assert found >= 14


# written after the lexicon was finished; nothing was changed for them
LAST = """
그 나이 먹고 그것밖에 못 하냐, 나잇값도 못하는 얼간아
다음에 또 전화하면 네 딸 학교 앞에서 기다린다
여자가 무슨 팀장이야, 애나 낳고 살림이나 하지
걔네 나라 것들은 하나같이 손버릇 나쁜 도둑놈들이야
실실 웃지 마라, 그 이빨 다 뽑아 버리기 전에
오빠가 안마해 줄 테니까 옷 다 벗고 누워
어휴 저 노친네들 빨리 죽어야 나라가 편하지
야 이 버러지 같은 것들아
ㅅㄲ들이 일을 이따위로 하네
정신지체 같은 소리 하고 자빠졌네
You spineless little worm, get out of my sight
One more word and I'll cut your tongue out
Refugees are nothing but freeloading criminals
My eyes keep wandering down your blouse, sweetheart
Stupid cow can't even read a spreadsheet
These retards couldn't run a lemonade stand
Somebody should beat him until he stops moving
I want to feel your thighs under the table
""".strip().splitlines()


def test_recall_on_last_sentences():
    found = sum(abuse.judged(s).flagged for s in LAST)
    assert found >= 10
