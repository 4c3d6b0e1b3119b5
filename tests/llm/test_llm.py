"""The llm operators: round trips, brute force and golden cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import encode, leaks, nearest, pages, sentences


# ------------------------------------------------------------------ nearest in time

def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    left = [(rng.choice("ab"), i, rng.randint(0, 400_000)) for i in range(300)]
    right = [(rng.choice("abb"), 1000 + i, rng.randint(0, 400_000)) for i in range(900)]
    right += [("a", 5000 + i, 1_000_000) for i in range(3)]
    left += [("a", 900, 1_000_050), ("a", 901, 999_950), ("c", 902, 5), (None, 903, 5), ("a", 904, None)]
    a = spark.createDataFrame(left + left[:10], "entity string, left_id long, at long")
    b = spark.createDataFrame(right + right[:10] + [("a", None, 7), (None, 1, 7)], "entity string, right_id long, at long")
    for bucket, per_task in ((10_000, 500_000), (10**9, 500_000), (10**9, 7)):  # wide, and divided by count
        got = {(r["left_id"], r["right_id"]) for r in nearest.nearest_in_time(a, b, 200, bucket, per_task).collect()}
        want = set()
        for e, i, t in left:
            if e is None or t is None:
                continue
            near = [(abs(t - u), u, j) for s, j, u in right if s == e and abs(t - u) <= 200]
            if near:
                want.add((i, min(near)[2]))
        assert got == want


def test_nearest_ties_and_empty(spark):
    a = spark.createDataFrame([("x", 1, 100)], "entity string, left_id long, at long")
    b = spark.createDataFrame([("x", 7, 90), ("x", 8, 110), ("x", 6, 90)], "entity string, right_id long, at long")
    assert [tuple(r) for r in nearest.nearest_in_time(a, b, 50).collect()] == [(1, 6, 10)]
    assert nearest.nearest_in_time(a, b.limit(0), 50).count() == 0
    assert nearest.nearest_in_time(a.limit(0), b, 50).count() == 0


# ------------------------------------------------------------------ encoding

TEXTS = ["Hello  world, it's 2024!\n\n\tnext", "", None, "日本語の文章。𠮷野", "ﬁn­e 𝓒 <|endoftext|> é", " " * 50 + "x", "a" * 5000 + " long " + "b " * 20000, "\r\n   ¼ ½", "हिन्दी और ภาษาไทย"]


def test_ids_equal_the_public_tokenizer_and_round_trip(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    enc = encode.encode_documents(df)
    got = {r["doc_id"]: r["ids"] for r in enc.collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (reference.encode(t, add_special_tokens=False).ids if t else [])
    back = {r["doc_id"]: r["text"] for r in encode.decode_documents(spark, enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_unknown_ids_and_empty_table(spark):
    bad = spark.createDataFrame([(1, [999_999]), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in encode.decode_documents(spark, bad).collect()} == {1: None, 2: ""}
    assert encode.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ leaks

PASSAGE = "Notice given after the term had ended is no notice at all, and in the November flood of 2021 the auctioneer Carham moved 11 lamp oil from Lowmarsh to Hexley Bay using borrowed barges of his own"
CHINESE = "钱甲的印章夹在26捆开裂的河沙之间，来自埃湖。北汶无人知晓王某明是否质押了34件种薯或向陈乙付过70141元。究竟周某明还是陈某华在北汶存放了那130袋印花布？"


def found(spark, texts, items=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    it = spark.createDataFrame(items or [(1, PASSAGE), (2, CHINESE), (3, None), (4, "too short"), (None, PASSAGE)], "item_id long, passage string")
    return {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, it).collect()}


def test_leaks_in_altered_form(spark):
    w = PASSAGE.split()
    texts = [
        "Intro. " + PASSAGE.upper() + " more",
        "x " + " ".join(w[5:25]) + " y",
        "x " + " ".join(w[5:22]) + " y",  # seventeen words
        " ".join(v if i % 11 else "█████" for i, v in enumerate(w, 1)),
        " ".join(v if i % 6 else "altered" for i, v in enumerate(w, 1)),
        " ".join(w[:12]) + "\nTribunal of Eskmere — KC-00-1/14 — Page 2 of 10\n" + " ".join(w[12:24]),
        PASSAGE.replace("auctioneer", "auc­\ntioneer").replace("flood", "ﬂood").replace(" ", "  "),
        "前" + CHINESE[10:55].replace("北", "某") + "后",
        CHINESE[:30],
        None, "",
    ]
    assert found(spark, texts) == {(0, 1), (1, 1), (3, 1), (5, 1), (6, 1), (7, 2)}


def test_leaks_empty_and_blocks(spark, monkeypatch):
    assert found(spark, ["some text"], [(4, "too short")]) == set()
    monkeypatch.setattr(leaks, "LARGEST_SET", 1)
    assert found(spark, [PASSAGE + " " + CHINESE]) == {(0, 1), (0, 2)}
    other = " ".join(reversed(PASSAGE.split()))
    monkeypatch.setattr(leaks, "HELD_TEXT", 10)  # several blocks beside several slices of documents
    assert found(spark, [PASSAGE, "", other, CHINESE, None], [(1, PASSAGE), (1, PASSAGE), (2, CHINESE), (3, other)]) == {(0, 1), (2, 3), (3, 2)}


def test_search_equals_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        item = [rng.choice("abcdefgh") for _ in range(30)]
        x = [rng.choice("abcdefghij") for _ in range(60)]
        at = rng.randint(0, 30)
        x[at : at + 25] = [c if rng.random() > 0.08 else "z" for c in item[:25]]
        p = leaks.PatternSet([(1, item)], leaks.WORDS)
        want = {(0, k, s) for s in range(len(x) - 4) for k in range(len(item) - 4) if x[s : s + 5] == item[k : k + 5]}
        assert set(p.occurrences(p.code(x))) == want


# ------------------------------------------------------------------ sentences

def units(text):
    out, at = [], 0
    for e in sentences.unit_ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


CASES = [
    ["Mr. and Mrs. Pelham live at No. 71, Vosvel Rd., Dunharrow.", "Costs follow at 3.26% p.a. of 1.5.", "That finding ... cannot stand.", "He held otherwise...", "There it was!"],
    ["The respondent is Tharstan Trading Co.", "C. E. Dungar gave evidence.", "Pelton Inc. appealed (see App. 9. The note says so).", "So be it."],
    ['The witness said: "I saw it. It was damp."', "Para. 5 says only this.", "“Was it late? I cannot say,” answered Tordale.", "No answer came."],
    ["Am 24. Oktober 2001 hat z. B. Fr. Kess nach § 157 Abs. 2 S. 1 MarktO ca. 3 Posten geprüft.", "Vgl. OLG Altmoor, Rn. 3 m. w. N.", "Hr. Dr. Weiler kam.", "Er sagte: „Ich kam. Ich sah.“", "Zu Recht!"],
    ["M. Gignac c/ Marlier S.A. n'a pas comparu.", "Cf. Cass. com. Aumoor, n° 96-462, p. 123, n° 2.", "« Je refuse ! », répondit Me Martour.", "Le juge a relevé : « Rien n'est prouvé ! »", "Il n'en est rien !"],
    ["Véase STS Almora núm. 7/2001, pág. 130, núm. 154.", "—No firmé nada —dijo el Sr. Galrosa.", "¿Quién pesó las pizarras?", "¡No!"],
    ["Договор от 20 января 1992 г. предусматривал оплату 8,5 тыс. руб. за 21 партий.", "Истец А. Н. Ворентьев из г. Бренвик, и др. лица, т. е. ст. 19.", "«Это не так», — заявил Колецкий."],
    ["قال الشاهد: «رأيت البضاعة. كانت متأخرة.»", "انظر الطعن رقم 471/2018، ص. 27.", "طلب د. ناجد مبلغ 71490.5 دينار."],
    ["अनुबंध 566149.50 रुपये का था।", 'गवाह ने कहा: "मैंने माल देखा। वह पुराना था।"', "(2016) 554 आ.नि. 14, पृ. 113 देखें।"],
    ["Das ist ein Satz.", "Noch einer mit X. darin und [REDACTED] Ende."],
]


@pytest.mark.parametrize("want", CASES)
def test_sentences_of_a_block(want):
    assert units(" ".join(want)) == want
    assert [" ".join(u.split()) for u in units("\r\n".join(" ".join(want).split(" ")))] == [" ".join(u.split()) for u in want]


@pytest.mark.parametrize("want", [
    ["The answer is no.", "He left."], ["It was the best art.", "We left."], ["He got an ex.", "She left."], ["He has no para.", "She left."], ["See art. 5 and no. 7 of App. B here.", "Next."],
    ["Es war von dieser Art.", "Er ging."], ["Vgl. Art. 5 Abs. 2 BGB.", "Der Kläger, z. B. Hr. Dr. Meier, ging."],
    ["it rained.", "they left.", "he wept."], ["it rained.", "they left.", "he wept."] * 2, ["Er kam am 3. █ nach Wien."],
    ["The parties met at 9.30 a.m. █████ 4 May 2002 in Corvale.", "The rate was 7.31 per cent. […] annum until May."], ['It says only this: "Not admitted."', '"The stones were mine," she said.'],
])
def test_sentences_by_language_whatever_their_length_and_padding(want):
    text = " ".join(want)
    assert units(text) == want
    for blank in (" " * 8, " " * 20, "\r\n  ", " " * 300):
        assert [" ".join(u.split()) for u in units(text.replace(" ", blank))] == want
    for around in ("Er kam nach Wien und ist nicht mit dem Zug gefahren.", "El tren no es como los de la ciudad."):  # other languages beside it, another label
        assert units(around + "\n\n" + text)[1:] == want and [text[a:b].strip() for a, b in zip([0, *sentences.unit_ends(text, "es")], sentences.unit_ends(text, "es"))] == want


def test_headers_however_padded():
    for line in ("Court of Appeal of Aldmoor — HC-00-5562/24 — Page 2 of 11", "KC-00-3250/13    Tribunal    p. 2/14", "[2] High Court, RG-00-6415/23", "- 1 - RG-00-565/17", "阿原上诉法院 RG-00-6/09 第2页 共11页"):
        for n in (1, 40, 5000):
            text = "It was so\n" + line.replace(" ", " " * n) + "\nin law."
            assert [text[a:b] for a, b in pages.header_lines(text)] == [line.replace(" ", " " * n)]
    for line in ("as held in HC-00-5562/24; the page was 2.", "see HC-00-1/24 and HC-00-2/24, p. 3", "HC-00-1/24 was about the ship"):
        assert pages.header_lines(line) == []


def test_sentences_without_blanks():
    assert units("证人称：“我看见了木材。都已生锈。”通知是否及时送达？“不是我的！”陈丙回答说。货物……有理。") == ["证人称：“我看见了木材。都已生锈。”", "通知是否及时送达？", "“不是我的！”陈丙回答说。", "货物……有理。"]
    assert units("「違います。」と下崎は答えた。責任を負う（別紙33。なお写しも同じ）。") == ["「違います。」と下崎は答えた。", "責任を負う（別紙33。なお写しも同じ）。"]
    assert units("ให้ยกอุทธรณ์ จำเลยต้องชำระเงิน 17 บาทแก่ห้าง ศาล") == ["ให้ยกอุทธรณ์", "จำเลยต้องชำระเงิน 17 บาทแก่ห้าง", "ศาล"]
    assert units("Dem folgt der Senat nicht.Vgl. OLG Altmoor.Zu Recht!Er kam.") == ["Dem folgt der Senat nicht.", "Vgl. OLG Altmoor.", "Zu Recht!", "Er kam."]


def test_blocks_numbers_and_headers():
    text = "Court of Appeal\n\n12) The rate was 3.5 per\n[2] Court of Appeal of Aldmoor, RG-00-92/13\ncent. So be it.\n\nII. Merits\n\n[3] Court of Appeal of Aldmoor, RG-00-92/13\n\n(4) No.\n\n"
    ends = sentences.unit_ends(text)
    got, at = [], 0
    for e in ends:
        got.append(pages.without_headers(text[:e], fill=True)[at:e].strip())
        at = e
    assert [" ".join(g.split()) for g in got] == ["Court of Appeal", "12) The rate was 3.5 per cent.", "So be it.", "II. Merits", "(4) No."]


def test_empty_long_and_table(spark):
    assert sentences.unit_ends(None) == sentences.unit_ends("") == sentences.unit_ends(" \n\n \t") == []
    long = "One sentence here. " * 20_000
    assert len(sentences.unit_ends(long)) == 20_000
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, "")], "doc_id long, text string").withColumn("end_pos", F.lit(dt.date(2024, 1, 1)))
    assert sorted(tuple(r) for r in sentences.sentence_units(df).collect()) == [(1, 4), (1, 9)]


def test_leak_with_a_word_split_near_its_end():
    u = lambda words: leaks.units(leaks.normalise(" ".join(words)), False)
    w = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(40)]
    pad = [f"zq{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    p = leaks.PatternSet([(1, u(w))], leaks.WORDS)
    found = lambda words: p.found(p.code(u(pad + words + pad)))
    assert found(w[:17] + [w[17][:3], w[17][3:]] + w[18:22]) == {1}  # 21 of 22 words, the last four on the next diagonal
    assert found(w[:17] + w[18:22]) == {1}
    assert found(w[:12] + ["neu", "neu", "neu", "neu"] + w[16:18]) == set()
