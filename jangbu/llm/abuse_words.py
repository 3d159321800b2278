"""General vocabulary of abusive language, in Korean and English: fixed values, inflected by rules.

Entries are words, stems and set expressions of the languages, not sentences.
``~`` before a Korean entry lets it begin inside a word; ``$`` after it asks for
the end of the word or for a particle, a copula or a suffix of contempt.
"""

from __future__ import annotations

_JONG_B = 17  # the number of the final consonant of 럽, 겹


def adjective(stem: str) -> list[str]:
    """Beginnings of the forms of a Korean adjective or verb, by the kind of its stem."""
    if stem.endswith("하"):
        return [stem[:-1] + x for x in ("하", "한", "해", "했", "할", "함", "합")]
    if stem.endswith("르"):
        before = ord(stem[-2])
        return [stem, stem[:-1] + "른", stem[:-1] + "를", stem[:-2] + chr(before + 8) + ("라" if (before - 0xAC00) // 28 % 21 in (0, 8) else "러")]
    code = ord(stem[-1]) - 0xAC00
    if code % 28 == _JONG_B:
        open_ = stem[:-1] + chr(0xAC00 + code - _JONG_B)
        return [stem, *(open_ + x for x in ("우", "운", "울", "워", "웠", "움"))]
    if not code % 28 and code // 28 % 21 == 20:  # ends in ㅣ: 죽이, 때리
        last = ord(stem[-1])
        contracted = chr(0xAC00 + code // 588 * 588 + 6 * 28)  # ㅣ + ㅓ = ㅕ
        return [stem, *(stem[:-1] + chr(last + x) for x in (4, 8, 16, 17)), stem[:-1] + contracted, stem[:-1] + chr(ord(contracted) + 20)]
    return [stem]


def _all(*stems: str) -> list[str]:
    return [x for s in stems for x in adjective(s)]


# Words that insult whoever they are said of.
CURSES = """
~개새끼 ~개색끼 ~개쉐끼 개자식 개놈$ 개년$ 개같은 개소리 개수작 개쓰레기 개차반 개망나니 쌍놈$ 쌍년$ 상놈의 잡놈$ 잡년$ 썅 썅년 썅놈 씨팔 시팔 씨발 씨벌 씨부랄 씨불 쓰벌 시발$ 시발놈 시발년 시발새끼 시벌$ 쉬발 씹새 씹새끼 씹할 니기미 염병할 염병하 빌어먹을 우라질 육시랄 제기랄놈
~병신 븅신 빙신$ 등신$ 머저리$ 얼간이$ 멍청이$ 멍텅구리$ 또라이$ 돌아이$ 쪼다$ 찐따$ 찌질이$ 찌질한놈 팔푼이$ 칠푼이$ 바보새끼 바보자식 모지리$ 돌대가리 닭대가리 새대가리 빡대가리 깡통대가리 무뇌아 무뇌한 골빈 꼴통$ 밥버러지$ 버러지$ 식충이$ 밥벌레$ 거머리같은 인간말종 인간쓰레기 인간이하 ~쓰레기새끼 ~쓰레기놈 쓰레기같은놈 쓰레기같은년 쓰레기같은인간 쓰레기만도 벌레새끼 벌레만도 짐승만도 개만도 돼지새끼 원숭이새끼 후레자식 호로자식 호로새끼 화냥년 걸레년 걸레같은 창녀 갈보 미친놈 미친년 미친새끼 미친것$ 미친자식 또라이새끼 양아치새끼 양아치같은 거지새끼 거지같은놈 사기꾼새끼 도둑놈의새끼 죽일놈 죽일년 망할놈 망할년 못된놈 나쁜새끼 좆같 좆까 좆도 좆밥 존나 졸라못 지랄$ 지랄하 지랄이 지랄병 육갑 엿먹어 엿이나먹
~새끼들아 ~새끼야 ~새끼가 ~놈의새끼 ~년아$ ~놈아$ ~것들아$ 네놈 네년 니놈 니년 이년아 저년 그년 이놈아 이새끼 저새끼 그새끼 이자식아
기레기 느금마 니애미 니애비 니미럴 니엄마 엠창 애미없 애비없 에미없 애미가 애비가 어미가그렇게 부모없이 근본없는놈 가정교육 월급도둑 월급루팡 세금도둑 세금충 무능한놈 무능한것들 무능한인간 한심한놈 한심한년 한심한것 한심한인간 한심한새끼 멍청한놈 멍청한년 멍청한것 멍청한새끼 멍청한인간 비열한놈 비겁한놈 무식한놈 무식한년 무식한것 무식한새끼 더러운놈 더러운년 더러운새끼 더러운것들 추잡한놈 역겨운놈 역겨운년 역겨운새끼 파렴치한놈 찌질한놈 찌질한새끼 못난놈 못난것 덜떨어진 쓸개빠진 얼빠진 넋빠진 정신빠진놈 정신나간놈 정신나간년 간덩이가부 배은망덕한 천하의나쁜 후안무치한놈 어미도없는 버르장머리없 싸가지없 막돼먹은 돼먹지못한 되먹지못한 인두겁 철면피 좀벌레 잡종 쌍것 쌍것들 상것들 화상아 웬수같은 밉상 팔푼 반푼이 저능아 정박아 불구자새끼 병신자식
""".split()

# Slurs for groups of people.
SLURS = """
짱깨 짱개 쪽바리 쪽발이 왜놈들 떼놈들 되놈 깜둥이 검둥이 흰둥이새끼 양키놈 똥남아 개독 개슬람 김치녀 김치남 된장녀 한남충 한녀충 한남들 맘충 급식충 틀딱 틀딱충 연금충 노인충 꼰대새끼 똥꼬충 호모새끼 게이새끼 레즈년 보슬아치 꼴페미 페미년 메갈년 쿵쾅이 장애새끼 장애년 장애인새끼 애자새끼 절름발이새끼 귀머거리새끼 벙어리새끼 정신병자새끼 정신병자년 홍어새끼 홍어놈 통구이 흉노놈 과메기놈 촌놈들 촌것들 외노자새끼 불체자새끼 튀기새끼 잡종새끼 거지근성 빨갱이새끼 토착왜구새끼 수꼴새끼 좌좀 지잡대 지방충 임대충 빌거 엘사거지 흙수저새끼 알바충 이대남충 이혼충
""".split()

# What is said to humiliate, threaten or send to death.
HUMILIATION = """
닥쳐$ 닥쳐라 닥치고 닥치라 아가리닥 아가리를 주둥이닥 주둥이를 주둥아리 입닥 입다물 꺼져$ 꺼져라 꺼져버 꺼지라 썩꺼 당장꺼 찌그러져 뒈져 뒈지 뒤져라 디져라 뒤지고싶 나가죽 나가뒈 나가뒤 죽어라$ 죽어버려 죽어버리 죽어줘 죽어마땅 죽는게낫 죽는게도움 죽여달라 그냥죽어 가서죽어 혀깨물 접시물에 뛰어내려라 뛰어내리지 뛰어내려버 자살해라 자살이나 목매 목이나매 왜사냐 왜사니 왜사는지 왜살아 살가치 살아있을가치 태어나지말 태어나지를말 낳지말 인생낭비 인간도아니 인간이아니 사람도아니 사람이아니 사람새끼도 사람새끼냐 인간취급 사람취급도
낯짝 면상 상판대기 상판때기 쌍판 눈깔 아가리 주둥이$ 대가리에 대가리를 대가리가 대가리통 대갈통 대갈빡 골통을 뇌가없 뇌가있 뇌가썩 뇌는있 뇌를달 머리에똥 머리에뭐가 머리가나쁘 머리가나빠 머리는장식 머리나쁜 그머리로 저머리로 돌머리 생각이란걸 생각이란게 개념없는놈 싸가지 싹수 밥값도 밥만축 세금만축 세금이나축 공기가아깝 산소가아깝 숨쉬는게 얼굴만봐도 꼴도보기 꼴보기싫 꼬라지 꼬락서니 꼴값 꼴에 주제파악 주제도모르 주제에어디 주제에무슨 어디서감히 감히어디 침을뱉 침이나뱉 침뱉 토나온다 토나와 토할것 구역질나 역겨워서 재수없는놈 재수없는년 재수없는것 맞아야 맞고싶 처맞 쳐맞 매를벌 뺨을 싸대기 따귀를 훈계질 것들이무슨 것들이뭘 것들이감히 놈들이무슨 놈들이뭘 년들이뭘 년들이무슨
""".split()

THREATS = [
    *"~죽여버 ~죽여줄 ~죽여주마 ~죽여주겠 ~죽인다 ~죽여놓 ~죽일거 ~죽일테 ~죽이겠 ~죽이고싶 ~죽고싶냐 ~죽고싶어 ~죽고싶니 ~죽을줄 ~죽는다진짜 ~패죽 ~쳐죽 ~때려죽 ~찢어죽 ~밟아죽 ~말려죽 ~두들겨패 ~패버 ~패줄 ~족쳐 ~조져 ~찔러버 ~찔러죽 ~찔러줄 ~쑤셔버 ~쑤셔줄 ~쑤셔죽 칼로찌 칼로찔 칼로쑤 칼로그 칼들고찾 칼맞 칼침 도끼로 망치로머리 쇠파이프로 총으로쏴 ~쏴죽 목을따 목을조르 목을졸 목을비틀 목을쳐 목을치 목을날 목을꺾 모가지를 다리를부러 다리를분 다리몽둥이 다리를잘 팔을부러 팔을분 팔다리를 손목을잘 손모가지 뼈를부 뼈를분 갈비뼈를 턱을날 이빨을 이를다뽑 눈알을 눈을파 ~묻어버 ~묻어줄 파묻어 ~불질러 불을질러 불을지르 ~불싸질 ~불태워버 ~태워죽 ~박살내줄 ~박살낼 ~작살내 ~작살낼 ~가만안 가만두지않 가만히안 ~가만둘줄 무사할줄 무사하지못할 두고보자 각오해 후회하게해 후회하게만 밤길 뒤통수조심 뒤통수조심해 등뒤를조심 집주소다 집주소알 집주소도알 집이어딘지 집어딘지알 어디사는지 사는데알 학교도알 찾아가서죽 찾아가서패 찾아가서불 찾아가서찌 기다렸다가죽 가족까지 가족도무사 가족들도무사 가족을다 자식까지 자식새끼 애새끼 애들까지다 처자식까지 피를보 피바다 관짝 장례치를 제삿날 황천길 요단강 병원신세 살아서못나 살아서못돌아 못살게해줄 매장시켜버 인생끝장 산산조각내줄 본때를".split(),
]

# Parts of the body and what is threatened to be done to them, with or without a particle between.
BODY = "목 모가지 다리 다리몽둥이 팔 손목 손모가지 손가락 뼈 허리 턱 턱주가리 머리 머리통 대가리 골통 눈 눈알 눈깔 이빨 혀 혓바닥 주둥이 아가리 얼굴 면상 낯짝 귀싸대기 싸대기 뺨 뒤통수 배때기 배때지 창자 내장 심장 멱".split()
HARM = "비틀어버 비틀어줄 비틀기전 비틀고싶 비틀까 꺾어버 꺾어줄 꺾고싶 부러뜨려 부러트려 부러뜨릴 분질러 분지르 조르고싶 졸라버 졸라줄 잘라버 잘라줄 잘라낼 썰어버 썰어줄 따버 따줄 따고싶 찢어버 찢어줄 찢어놓 찢고싶 뽑아버 뽑아줄 뽑아놓 깨버 깨줄 깨부 깨놓 부숴버 부숴줄 부숴놓 박살 으깨 갈아버 갈겨 후려 걷어차 날려버 날려줄 날리기전 파버 파줄 도려 후벼 쑤셔 찔러 터뜨려 터트려 짓이겨 뭉개 갈라버 갈라줄 치고싶 때려주고 때리고싶".split()

# Words of sexual acts and parts, and what makes remarks of them.
SEXUAL = """
섹스 쎅스 쎅쓰 야동 자위하 딸딸이 딸치 떡치 떡치자 빠구리 빨아줘 빨아봐 빨아라 핥아 핥고 따먹 따먹고 박아줘 박고싶 싸고싶 꼴린 꼴려 꼴리 발기 물고빨 오르가 사정하고싶 젖통 젖가슴 젖탱 가슴만지 가슴을만 가슴좀 가슴한번 가슴이크 가슴커 가슴크 가슴사이즈 가슴주무 가슴을주무 가슴보여 엉덩이만 엉덩이를만 엉덩이주무 엉덩이한번 엉덩이를주무 엉덩이를때 엉덩이때 엉덩이흔 엉덩이가탱 엉덩이가예 엉덩이좀 허벅지만 허벅지를만 허벅지쓰다 허벅지를쓰 허벅지사이 허벅지가 다리벌 다리를벌 다리사이에 벗은몸 벗은사진 벗은모습 벗은거 벗어봐 벗어라 벗어줘 벗고와 벗고기다 벗고춤 벗고찍 벗겨 벗기고 홀딱벗 발가벗 벌거벗 알몸 나체사진 나체로 누드사진 누드로 속옷만 속옷벗 속옷을벗 속옷사진 속옷색 속옷입 속옷은무슨 속옷은뭐 속옷없 속옷보 팬티 노팬티 브라벗 브라자 노브라 치마속 치마밑 치마들 치마짧 치마가짧 짧은치마 안에뭐입 몸매죽 몸매가죽 몸매끝 몸매가끝 몸매좋 몸매가좋 몸매감상 몸매보 몸매가섹 섹시 야한사진 야한영상 야한동영상 야한옷 야한얘기 야한이야기 야한생각 야한짓 음란한짓 음란한사진 음란한영상 음란한말 몰래찍은 몰래찍어 몰카찍 샤워하는거 샤워하는모습 샤워하는사진 샤워같이 같이샤워 같이자자 같이잘래 같이자고 나랑자 나하고자 나랑잘 한번자자 한번자줘 한번줄래 한번하자 한번만하자 한판뛸 한판뛰 하룻밤 오늘밤나 오늘밤같이 오늘밤어때 오늘밤에같이 원나잇 모텔가 모텔로 모텔에 호텔방에서둘 방하나잡 한방쓰 한방에서자 같은방쓰 한이불 한침대 침대에서 잠자리가 잠자리를 잠자리한 잠자리하 잠자리상대 몸으로접 몸으로때 몸으로갚 몸을팔 몸파는 몸한번 몸좀 술시중 술따르라 술이나따 성접대 성노예 조건만남 원조교제 스폰해 애인하자 애인해줘 첩으로 변태새끼 변태짓 흥분돼 흥분되 흥분시 흥분될 쌌다고 윤간 강간하 강간해 강간당 덮쳐 덮치고 겁탈 보지년 보짓 자짓 자지빨 자지를 처녀막 처녀냐 처녀맞
""".split()

# Groups of people, as they are spoken of; what is said of them; what is asked for them.
GROUPS = """
여자 여자들 여자애들 여자란 여편네 계집 계집애 아줌마 아줌마들 아저씨들 남자 남자들 남자새끼 남성 남성들 여성 여성들 ~출신들 ~출신은 ~출신이 사투리쓰는 노인 노인네 노인들 늙은이 늙은것 할배 할망구 노친네 장애인 장애우 불구 병자들 정신병자 환자새끼 외국인 외국놈 외국인노동자 이주민 이주노동자 이민자 난민 불법체류자 중국인 중국놈 조선족 일본인 일본놈 미국놈 흑인 백인 동남아 베트남 필리핀 몽골 아랍 인도놈 무슬림 이슬람 유대인 기독교인 예수쟁이 불교도 신천지 동성애자 게이 레즈비언 성소수자 트랜스젠더 전라도 경상도 충청도 강원도 제주도 호남 영남 시골사람 시골놈 시골것 지방사람 지방출신 지방대출신 촌사람 촌놈 탈북자 탈북민 북한놈 새터민 다문화 혼혈 임산부 애엄마 엄마들 미혼모 이혼녀 이혼남 청소년 요즘애들 젊은것 젊은놈 초딩 중딩 고딩 대학생놈 가난한 거지들 빈민 노숙자 노숙인 기초수급자 수급자들 임대아파트 비정규직 알바생 청소부 경비원 배달부 택배기사 공무원놈 공무원새끼 교사놈 기자놈 정치인놈 의사놈 판사놈 경찰놈
""".split()
CONTEMPT = [
    *_all("더럽", "역겹", "미개하", "열등하", "천박하", "천하", "무식하", "게으르", "멍청하", "아둔하", "비열하", "교활하", "지저분하", "혐오스럽", "징그럽", "쓸모없"),
    *"냄새나 냄새가나 악취 토나 구역질 밥만축 세금만축 세금이나축 세금충 기생충이 기생충들 기생충같 벌레들 벌레같 벌레이 벌레다 바퀴벌레 구더기 해충같 짐승들 짐승같 짐승이 짐승이나 원숭이같 돼지같 개돼지 쓰레기들 쓰레기같 쓰레기다 쓰레기야 쓰레기이 암덩어리 암적인 좀먹 사회악 말종 종자 족속 것들 사기꾼들 죄다사기 다사기꾼 범죄자들 죄다범죄 다범죄자 전부범죄 잠재적범죄 도둑놈 거짓말쟁이 배신자 뒤통수나 뒤통수를 머리가나 머리나쁘 머리가비 뇌가 말이안통 말을못알아 말귀 못배운 배운게없 근본없 근본이 태생이 태생부터 유전자가 핏줄이 피가더 원래그 원래더 원래게 믿을수가없 믿을놈 믿으면안 상종 사람취급 인간취급 사람이아 인간이아 사람도아 인간도아 골빈 몸이나팔 애나낳 애나봐 집에나 집에서밥 집에서애 부엌에 솥뚜껑 일도못하 아무짝에도 존재자체 짐만되 민폐 재앙 역병 세균같 병균".split(),
]
REMOVAL = "몰아내 쫓아내 내쫓 추방해 추방시켜 쫓아버 쓸어버 쓸어내 박멸 말살 씨를말 없애버 없애야 없어져야 없어져라 사라져야 사라져라 죽어야 죽여야 다죽 죄다죽 전부죽 모조리 싸그리 불태 태워버 가둬 가두어야 격리시켜야 수용소 때려잡 처넣 쳐넣 처박 돌아가라 꺼져 니네나라 너희나라로 자기나라로 받지말아야 받으면안 들이지말 출입금지시켜 투표권을 투표권뺏 거세 낙태시켜 밖에나오지 나오지좀 교실에두지 같이못 함께못 못들어오게".split()
# Whom a text speaks to or of with contempt.
TARGETS = "너는$ 너희 너네 너같은 너따위 네까짓 니까짓 니들 니네 당신같은 당신들 당신네 저것들 이것들이 그것들 이놈 저놈 그놈 이자식 저자식 그자식 이인간 저인간 그인간 ~놈들 ~년들 ~것들 ~새끼 ~족속 ~종자".split()
# Doubtful alone; two of them in one passage count.
DOUBTFUL = [
    *"~놈들$ ~놈아 ~년들$ 돼지야 애들은원래 손버릇 바보$ 쓰레기$ 벌레$ 기생충$ 짐승$ 돼지$ 거머리$ 양아치$ 사기꾼$ 찌질 꼰대$ 한심하 한심한 무능하 무능한 뻔뻔하 뻔뻔한 어이없는놈 ~새끼 ~것들이 계집 천박 더러운 역겨 추잡 비열 비겁한 멍청 무식 미개 저능 구제불능 형편없는놈 개판 엉망진창이다 미친$ 미쳤 돌았냐 제정신이냐 정신나간 꺼지 닥치 운운하 세금이아까 관례아니 말이안통한 수준하고 수준이하 자격미달인간 죽을래 맞을래 너따위 네까짓 니까짓 주제에 감히 훈수질 갑질이나".split(),
]
# Neutral words and uses; entries inside them do not count.
SPARED = """
음식물쓰레기 생활쓰레기 쓰레기수거 쓰레기종량 쓰레기처리 쓰레기매립 쓰레기통 쓰레기봉투 쓰레기값 쓰레기배출 쓰레기분리 쓰레기소각 쓰레기집하 쓰레기수 해충벌레 벌레방제 벌레퇴치 벌레제거 벌레물 기생충검사 기생충조사 기생충학 기생충감염 기생충약 기생충구제 돼지고기 돼지열병 돼지농가 미친듯 영향을미친 영향이미친 효과를미친 미친영향 시발점 시발역 시발택시 병신년 발기인 발기부 발기대회 발기설 발기하여 섹스리스 동물학대 강간죄 강간예방 강간범죄 강간피해 윤간죄 성폭력 성희롱 성매매 성범죄 성추행 몰카점검 몰래카메라 도끼로나무 뺨을스치 주둥이부분 침대에서떨어 침대에서낙상 짧은치마길이 가슴을펴 등신대 등신불 상판을 교량상판 상판보수 다리를건 침을놓 한방에서치 눈깔사탕 밤길안전 밤길보행 안심밤길 밤길조명 밤길을밝 어두운밤길 개판본 대가리가큰못 대가리를가진 모가지를수확 토할것같은환자 호텔방에서둘러 모텔로등 모텔에화재 팔을부러뜨린환자 다리를부러뜨린환자
""".split()
# Technical and natural things that are killed or burnt without harm to anybody.
HARMLESS = "프로세스 프로세서 세션 스레드 쓰레드 작업을 데몬 좀비 세균 균을 해충 벌레를 잡초 바이러스 곰팡이 모기 병원균 소음 먼지 기를 속도 온도 맛 냄새를 색".split()

LATIN = {
    # strong: insults and profanity whoever they meet
    "strong": """
        idiot moron imbecile cretin dimwit halfwit nitwit dumbass jackass asshole arsehole shithead dipshit dickhead scumbag douchebag bastard bitch whore slut skank cunt twat wanker motherfucker cocksucker retard fuckwit numbskull dunce degenerate lowlife subhuman fatass dumbfuck prick schmuck hag crone shrew harlot tramp floozy bimbo slob scumbucket pervert pedo paedo nutjob psycho lunatic simpleton blockhead bonehead airhead meathead pinhead dumbo buffoon ignoramus shitbag arsewipe tosser bellend knobhead pillock wimp sissy pansy homo lezzie
        fuck fucker fucking fucked moronic idiotic brainless retarded bullshit faggot fag nigger nigga kike chink gook spic wetback tranny dyke towelhead raghead
    """,
    # doubtful: insults only when somebody is called so
    "mild": """
        fool clown loser liar coward pig rat cow worm snake trash garbage vermin parasite cockroach scum filth jerk creep crook thief thug savage animal freak monkey dog leech weasel stupid dumb pathetic ugly disgusting worthless useless incompetent ignorant filthy lazy spineless shitty shit crap damn damned hell sick vile wretched clueless gutless repulsive hideous stinking rotten braindead hopeless crooked dishonest waste joke disgrace failure nobody burden disease
    """,
    "set": """
        go to hell|burn in hell|rot in hell|drop dead|go die|kill yourself|kill yourselves|hang yourself|shoot yourself|neck yourself|end your life|shut up|shut your mouth|shut the hell up|shut your face|shut your trap|piss off|screw you|get stuffed|eat shit|kiss my ass|suck my|lick my|blow me|up yours|piece of shit|piece of trash|piece of garbage|sack of shit|waste of space|waste of oxygen|waste of skin|waste of air|human trash|human garbage|human waste|son of a bitch|damn fool|crawl back|make me sick|makes me sick|makes me puke|make me puke|come for your family|come for your kids|coming for you|come after you|come after your|watch your kids|take a bullet|put a bullet|beat the crap|beat the shit|kick your|kick his ass|kick her ass|break your|break both your|smash your|bash your|punch your|slap you|wring your neck|rip your|get the hell out|get lost you|sod off|bugger off|bite me|drag her by|dragged by her|dragged out by|look like a pig|look like a cow|hope you die|hope you rot|hope you choke|hope you suffer|hope you burn|hope you get|wish you were dead|better off dead|should just die|should be dead|nobody likes you|nobody would miss you|would miss you|jump off|off a bridge|off the roof|off a cliff|slit your|cut your throat|watch your back|watch yourself|one eye open|where you live|where your kids|where your family|where your children|i will find you|we will find you|i will end you|i will ruin you|you are dead|you re dead|dead meat|dead man|you will pay|you will regret|make you pay|make you suffer|teach you a lesson|your days are numbered|too dumb to|too stupid to|how stupid are|how dumb are|are you stupid|are you retarded|brain of a|back to your country|back where you came|back to where you|out of our country|in the kitchen|breed like|filthy liar|stupid liar
    """,
    "sexual": """
        nudes|send nudes|naked picture|naked pictures|naked pics|naked photo|naked photos|nude pics|nude picture|nude pictures|nude photo|nude photos|nude selfie|topless|sex with|have sex|having sex|had sex|want sex|sleep with me|sleep with you|sleep with us|slept with him for|nice rack|nice tits|nice ass|great rack|that ass|those legs|those tits|those boobs|those curves|bedroom eyes|hook up with you|fool around with|one night stand|get laid|skinny dip|french kiss|lap dance|sugar baby|booty call|strip poker|wet dream|in the sack|do you shave|are you a virgin|your tits|your boobs|your breasts|your ass|your butt|your panties|your underwear|your bra|your legs|your naked|your body|her tits|her boobs|her ass|big tits|big boobs|blow job|blowjob|handjob|hand job|jerk off|jerking off|masturbate|masturbating|horny|orgasm|cum on|pussy|my dick|my cock|your dick|your cock|porn|porno|strip for|strip naked|undress for|take off your clothes|take off your shirt|take off your blouse|take your clothes off|touch yourself|touch me|touch your|touch you|grope|fondle|spread your legs|bend over|bent over|on your knees|on my lap|in my bed|in bed with|into bed|share my bed|hotel room tonight|my hotel room|come to my room|turn me on|turns me on|turned on|what are you wearing|wear nothing|wearing nothing|nothing on|without underwear|without panties|without a bra|no underwear|no panties|under that skirt|under your skirt|under your dress|up your skirt|under that dress|sexy|hot body|hot bod|kinky|threesome|rape you|gang bang|sugar daddy|milf
    """,
}
PEOPLE = """
women woman girls females men males foreigners immigrants migrants refugees muslims jews christians hindus catholics blacks whites asians africans arabs chinese japanese koreans indians mexicans pakistanis turks russians poles gypsies roma gays lesbians homosexuals queers trans transgenders disabled cripples handicapped elderly pensioners boomers teenagers kids poor homeless beggars peasants villagers southerners northerners rednecks natives feminists blondes mothers housewives orphans addicts
""".split() + ["old people", "old folks", "old men", "old women", "young people", "poor people", "black people", "brown people", "white people", "gay people", "fat people", "disabled people", "these people", "those people", "you people", "their kind", "your kind", "that lot", "people like you", "people like them"]  # fmt: skip
SAID_OF = """
animals animal vermin parasites cockroaches rats pigs dogs monkeys apes trash garbage filth filthy scum subhuman inferior stupid dumb lazy disgusting dirty criminals criminal thieves thief liars rapists terrorists savages savage barbarians diseased disease plague cancer virus pest pests stink smell breed worthless useless retarded ignorant primitive uncivilized emotional hysterical weak brainless disgrace burden leeches freeloaders scroungers waste evil sick perverts degenerates idiots morons
""".split()  # fmt: skip
DONE_TO = """
exterminated eliminated eradicated wiped gassed shot killed hanged burned burnt deported expelled banned sterilized castrated locked caged rounded thrown kicked driven put removed die disappear rot suffer
""".split()
VIOLENCE = "kill murder stab shoot strangle choke smash break burn rape hurt beat slap punch bury skin gut hunt cut slit crush destroy behead poison bomb".split()
OF_SOMEBODY = "you your him his her them their everyone everybody family kids children wife daughter son mother".split()
INTENT = "will ll gonna going want wanna would love should must someone somebody better let until before next".split()
# Neutral uses and rules against such language.
SPARED_LATIN = """
garbage truck|garbage trucks|garbage collection|garbage collector|garbage collectors|garbage can|garbage bin|waste collection|trash bin|trash bins|trash folder|trash can|trash removal|trash collection|waste and trash|waste water|pest control|parasite survey|parasite surveys|dumb terminal|dumb terminals|dumb waiter|dumb pipe|hate speech and nude images|nude images within|nude image|sexual harassment|abusive language|hate speech|sex education|sex offender|sex offenders|same sex|single sex|sex ratio|sex of the|naked eye|naked wire|cock valve|stop cock|bastard file|male and female|porn filter|porn filtering|porn sites are|block porn|blocking porn|kill switch|sick leave|sick day|sick building|animal feed|dog park|guide dog|burden of proof|failure rate|failure of|proof of concept
""".strip().split("|")  # fmt: skip
