import random
import unicodedata

from conftest import rows

from jangbu.llm import leaks


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_against_brute_force(spark):
    """Documents of words, with shuffled, cut and altered parts of items among others: same pairs as word LCS, where a share is not within a word or two of the border."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("가나다라마바사아자차카타파하") for _ in range(r.randint(2, 4)))
    items = {i: [word() for _ in range(r.randint(12, 30))] for i in range(8)}
    docs = {}
    for d in range(60):
        w = [word() for _ in range(r.randint(0, 60))]
        for i in r.sample(sorted(items), r.randint(0, 2)):
            n = len(items[i])
            part = items[i][: r.choice([3, n // 4, n - 4, n])]
            part = [word() if r.random() < 0.08 else x for x in part]
            cut = r.randint(0, len(part))
            w = w[:20] + part[:cut] + [word() for _ in range(r.choice([0, 0, 5, 40]))] + part[cut:] + w[20:]
        docs[d] = w
    got = leaks.leaks(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    found = {(x.doc_id, x.item_id) for x in got.collect()}
    n = 0
    for d, w in docs.items():
        for i, item in items.items():
            share = lcs(item, w) / len(item)
            if abs(share - 0.5) > 0.12:
                assert ((d, i) in found) == (share >= 0.5), (d, i, share)
                n += share >= 0.5
    assert n > 10


def test_forms(spark):
    item = "전력 사용량이 7,828킬로와트를 넘는 날에는 일괄 작업을 49시간 뒤로 미룬다. 현장 표지판 13개의 점자가 거꾸로 붙어 있어 새로 달았다."
    en = "The panel asked why the diesel generator had been tested only 3 times in 4 quarters."
    half = " ".join(item.split()[:4])
    texts = [item, item.replace(" ", ""), item.replace(" ", "  \n"), "<p>" + item.replace(". ", ".<br/>") + "</p>", "&lt;td>" + item + "&lt;/td>", unicodedata.normalize("NFD", item), item.replace("넘는", "지나는").replace("새로 ", ""), item.replace("날에는", "날에는 " + "다른 글이 사이에 있다. " * 20), en.upper(), en.replace("e", "е"), half, None, "", " ", "무관한 글 " * 9_000, item]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, item, 7)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, item, "x"), (2, en, "x"), (3, None, "x"), (4, "...", "x"), (None, item, "x")], "item_id long, text string, term string")
    assert rows(leaks.leaks(docs, items).select("doc_id", "item_id")) == sorted([(i, 1) for i in (*range(8), 15)] + [(8, 2), (9, 2)], key=repr)
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_words_parted_from_each_other(spark):
    item = "전력 사용량이 7,828킬로와트를 넘는 날에는 일괄 작업을 49시간 뒤로 미룬다 현장 표지판 점자가 거꾸로 붙어 있어".split()
    half = item[::2]  # every second word
    texts = [" ".join(f"{w} 다른{i}" for i, w in enumerate(half)), "<br>".join(f"{w}, 사이에 선 글{i}" for i, w in enumerate(half)), " ".join(f"{w} 다른{i}" for i, w in enumerate(half[1:])), " ".join(f"{w} 다른{i}" for i, w in enumerate(half[::-1])), "".join(f"{w}다른{i}" for i, w in enumerate(half)), " ".join(item[:3]).replace(" ", "") + " 그 밖에 " + " 또 ".join(item[4:13:2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = leaks.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    # parted, parted by markup, one word too few, in another order, inside longer words, partly written together
    assert rows(got.select("doc_id", "item_id")) == [(0, 1), (1, 1), (5, 1)]


def test_numbers_are_one_word():
    assert leaks.in_order(["6", "개"], *leaks.pieces("6,414 세션과 6 개, 1.6개")) == 2
    assert leaks.in_order(["6"], *leaks.pieces("6,414 세션과 1.6개")) == 0


def test_words_in_order_against_brute_force():
    r = random.Random(9)
    for _ in range(200):
        item = [r.choice(("가", "나나", "다", "라라")) for _ in range(r.randint(1, 9))]
        text = [r.choice(("가", "나나", "다", "라라", "마")) for _ in range(r.randint(0, 25))]
        free = leaks.in_order(item, *leaks.pieces(" ".join(text)))
        assert free >= lcs(item, text)
        spread = leaks.in_order(item, *leaks.pieces(" 마 ".join(text)))
        assert spread == lcs(item, text)


def test_recall_on_altered_items(spark):
    """Interleaved, halved, altered and glued items are all found; a third of an item, and an item backwards, never."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("가나다라마바사아자차카타파하") for _ in range(r.randint(2, 4)))
    items = {i: [word() for _ in range(20)] for i in range(10)}
    true, false = {}, {}
    for i, w in items.items():
        other = [word() for _ in w]
        kinds = [[x for p in zip(w, other, strict=True) for x in p], w[:10], w[::2], [x if r.random() < 0.7 or k < 10 else word() for k, x in enumerate(w)], ["".join(w[:8]), *other, "".join(w[8:16])]]
        for k, t in enumerate(kinds):
            true[10 * i + k] = (i, " ".join(other[:5] + t + other[5:]))
        for k, t in enumerate((w[:7], w[::-1], ["".join(x + y for x, y in zip(w, other, strict=True))])):
            false[1000 + 10 * i + k] = (i, " ".join(other + t))
    docs = spark.createDataFrame([(k, t) for k, (_, t) in (true | false).items()], "doc_id long, text string")
    got = leaks.leaks(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(k, i) for k, (i, _) in true.items()}


def test_offsets_and_free_places():
    sizes = [2, 3, 1]
    assert leaks.in_line({0: [10], 1: [14], 2: [20]}, sizes) == 3  # at 5, 7, 10: one phrase inside a longer stretch
    assert leaks.in_line({0: [10], 1: [16], 2: [24]}, sizes) == 0  # parted, none free
    assert leaks.in_line({0: [11], 1: [17], 2: [25]}, sizes) == 3  # parted, all free
    assert leaks.in_line({0: [25], 1: [17], 2: [11]}, sizes) == 1  # backwards
    assert leaks.in_line({}, sizes) == 0
