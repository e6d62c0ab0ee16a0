import pytest

from netloom.llm.sentences import sentences

CASES = [
    ("We tried ducts, poles, etc. Per memo No. 110, it fails. Use approx. 74 cm, i.e. two loops.", ["We tried ducts, poles, etc.", "Per memo No. 110, it fails.", "Use approx. 74 cm, i.e. two loops."]),
    ("See https://a.example/t/60.html for it.In my case v. 3.14.8 of plan_20.json fails! Why?", ["See https://a.example/t/60.html for it.", "In my case v. 3.14.8 of plan_20.json fails!", "Why?"]),
    ('"Is it closed?" is the first thing. The wizard says "Nothing to do." and quits. It waits ... and then stops.', ['"Is it closed?" is the first thing.', 'The wizard says "Nothing to do." and quits.', "It waits ... and then stops."]),
    ("« Le poteau est-il fermé ? » est la bonne question. M. Vaudric a noté « fini. » sur le plan. Ça marche !", ["« Le poteau est-il fermé ? » est la bonne question.", "M. Vaudric a noté « fini. » sur le plan.", "Ça marche !"]),
    ("Am 3. Mai gilt Nr. 192 nicht, vgl. S. 9. „Ist er zu?“ fragte sie. Danke!", ["Am 3. Mai gilt Nr. 192 nicht, vgl. S. 9.", "„Ist er zu?“ fragte sie.", "Danke!"]),
    ("¿Por qué falla?Falta el núm. 7 en la lista.Con la Sra. Belmar (v. pág. 4) no.", ["¿Por qué falla?", "Falta el núm. 7 en la lista.", "Con la Sra. Belmar (v. pág. 4) no."]),
    ("На ул. Южная запас, т. е. две петли по 219 см. «Шкаф закрыт?» – спросили.", ["На ул. Южная запас, т. е. две петли по 219 см.", "«Шкаф закрыт?» – спросили."]),
    ("她问“管道关好了吗？”就走了。（这种情况。）可以了！用3.2版打开a.dxf以后不见了。", ["她问“管道关好了吗？”就走了。", "（这种情况。）", "可以了！", "用3.2版打开a.dxf以后不见了。"]),
    ("「閉じていますか？」と聞かれました。動きました！", ["「閉じていますか？」と聞かれました。", "動きました！"]),
    ("डॉ. वेलमोरा कहती हैं। क्या ऐसे देखा है? काम हो गया!", ["डॉ. वेलमोरा कहती हैं।", "क्या ऐसे देखा है?", "काम हो गया!"]),
    ("هل رأى أحد ذلك؟ الكابل يبعد 42.23 م. نجح الأمر!", ["هل رأى أحد ذلك؟", "الكابل يبعد 42.23 م.", "نجح الأمر!"]),
    ("ลองตั้งค่าเป็น 30.32 แล้วรันใหม่นะคะ มีใครเคยเจอ ใช้ได้แล้วค่ะ", ["ลองตั้งค่าเป็น 30.32 แล้วรันใหม่นะคะ", "มีใครเคยเจอ ใช้ได้แล้วค่ะ"]),
    ("A title\n\nIt breaks\nhere. Yes.\n\n- one item\n- two. Three!\n1) four\n> quoted. Text\n\n```sql\nSELECT 1. Two.\n```\nAfter `a.b. C` it.\n\n    code. Here.\n    more\n\nEnd", ["A title", "It breaks\nhere.", "Yes.", "one item", "two.", "Three!", "four", "quoted.", "Text", "After `a.b. C` it.", "End"]),
    ("In the U.V.R. district. Around 5 p.m. `x()` stops. until 7 p.m. The end", ["In the U.V.R. district.", "Around 5 p.m. `x()` stops.", "until 7 p.m.", "The end"]),
    ("😀 Hi. 😀 Yes.", ["😀 Hi.", "😀 Yes."]),
    ("~~~\nnever closed. So.\n", []),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(k, t, "x", 7) for k, (t, _) in enumerate(CASES)] + [(900, None, "x", 7), (901, "", "x", 7), (902, " \n\t  ", "x", 7), (903, "---\n...", "x", 7), (904, "Twice.", "x", 7), (904, "Twice.", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sentence string, start_pos int")
    out = {}
    for r in sentences(df).collect():
        out.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"], r["sentence"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(got, k):
    text, want = CASES[k]
    assert [s for _, _, s in got.get(k, [])] == want
    for a, b, s in got.get(k, []):
        assert text[a:b] == s == s.strip()


def test_blank_and_repeated(got):
    assert {k: len(got.get(k, [])) for k in range(900, 905)} == {900: 0, 901: 0, 902: 0, 903: 0, 904: 2}


def test_very_long(spark):
    text = "It works at 3.5 m. " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sentences(df).count() == 20_000
    assert sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_full_stops_of_other_scripts(spark):
    texts = ["ဒါက ပထမ။ ဒါက ဒုတိယ။", "ይህ አንድ ነው። ይህ ሁለት ነው።", "Սա առաջինն է։ Սա երկրորդն է։", "នេះគឺមួយ។ នេះគឺពីរ។", "འདི་གཅིག་རེད། འདི་གཉིས་རེད།", "ⴰⵣⵓⵍ᙮ ⴰⵣⵓⵍ᙮"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sentences(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["sentence"]))
    for i, t in enumerate(texts):
        assert len(got[i]) == 2 and all(t[at : at + len(s)] == s for at, s in got[i])


def test_a_paragraph_of_very_many_lines(spark):
    text = "One line goes on\nhere. " * 20_000
    got = sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got) == 20_000 and {r["sentence"] for r in got} == {"One line goes on\nhere."}
