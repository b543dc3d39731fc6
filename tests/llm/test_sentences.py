import random

import numpy as np
import pytest

from strandworks.llm.sentences import _gather, sentences_of, split_sentences, train

NAMES = [a + b for a in ("Mil", "Tor", "Zan", "Ket", "Bra", "Fyn") for b in ("ori", "hul", "vel", "dru", "nus", "wek")]
#: Sentences by language: plain ones, and ones with marks that end nothing.  {N} is a
#: name, {d} a number, {w} one of the nouns.
LANGUAGES = {
    "en": (" ", "lamp kettle strap zipper tripod seal handle", [
        "The {w} from {N} works well", "My aunt agrees", "Next to the {N}, this {w} stays quiet", "Even the {w} has stayed on", "We paid for the {w} and the {w}",
        "It weighs approx. {d}.{d} kg, i.e. less than the old {w}", "The seller, T. {N}, replied at 9 a.m. the next day", "I paid {d} dollars for it at St. {N} Market",
        'My aunt asked "Is that all?" before she opened the {w}', 'The leaflet says "Do not rinse. Wipe only." and nothing else', "It worked ... well, for {d} hours", "The {w} has version {d}.{d}.{d} of the firmware"]),
    "de": (" ", "Kabel Ventil Rohr Gehäuse Fach", [
        "Das {w} von {N} hält gut", "Meine Tante sieht das genauso", "Inzwischen klemmt das {w}", "Selbst bei {d} Grad bleibt alles leise", "Nach {d} Tagen ging es zurück",
        "Es wiegt ca. {d},{d} kg, d. h. weniger als das alte", "Geliefert wurde am 3. Mai gegen 9 Uhr", "Siehe Abb. {d} auf S. {d} der Anleitung", "Auf der Packung steht „Nicht spülen. Nur wischen.“ und sonst nichts"]),
    "fr": (" ", "câble socle bouton fermoir", [
        "Le {w} de {N} tient bien", "Ma voisine pense pareil", "Au deuxième essai, le {w} se bloque", "Tout reste léger", "Depuis {d} semaines, le {w} sent la colle",
        "Voir p. {d} du livret, réf. {d}, pour les pièces", "Il pèse env. {d},{d} kg", "La notice dit « Ne pas rincer. Essuyer seulement. » et rien d'autre"]),
    "es": (" ", "cable cierre soporte broche", [
        "El {w} de {N} aguanta bien", "Mi prima opina igual", "Según el folleto, el {w} se atasca", "Todo sigue fácil de limpiar", "Incluso a {d} grados, el {w} encaja",
        "Véase la pág. {d} del manual", "Pagué {d} euros al Sr. {N} en el mercado", "El folleto dice «No enjuagar. Solo limpiar.» y nada más"]),
    "ar": (" ", "الزر القفل المقبض الغطاء", ["يعمل {w} بشكل جيد", "يغلق {w} بإحكام", "بصراحة، انكسر {w} بسرعة", "حتى في {d} درجة، بقي كل شيء هادئ", "قال د. {N} إن المادة آمنة", "كتب على العلبة «لا تغسل. امسح فقط.» ولا شيء غير ذلك"]),
    "hi": (" ", "बटन फीता ढक्कन हत्था", ["{w} ठीक से चलता है", "नीला {w} टूट गया", "सच कहूँ तो, सब कुछ हल्का रहा", "{d} दिन में टूट गया", "मैंने रु. {d} दिए", "डॉ. {N} ने भी यही लिया"]),
    "ja": ("", "紐 網 台 留め金", ["{w}がぴったり合います", "説明書によると、{w}の閉まりが良いです", "同僚も同じ意見です", "{d}日間使っても問題ありません", "店員は「止めて！漏れている！」と言っていました", "型番はNo.{d}（旧型。色は緑）となっている"]),
    "zh": ("", "带子 盖子 把手 底座", ["每个{w}都合适", "老师也这么认为", "即使在{d}度，整体很安静", "打开盒子的时候，{w}有胶水味", "说明书上写着“不要冲洗。只能擦。”就没有别的了", "宽{d}.{d}厘米（比盒子略大。颜色偏绿），放得下"]),
    "th": (" ", "ฝา ปุ่ม สาย ฐาน", ["{w}ปิดสนิท", "น้องชอบ{w}มาก", "ราคา {d} บาทรวมส่ง", "พูดตามตรง{w}หลุดง่าย", "ใช้มา {d} เดือนแล้วทุกอย่างเงียบ"]),
}
ENDS = {"ar": ".!؟", "hi": "।।!", "ja": "。。！", "zh": "。。！", "th": ""}


def _document(rng, lang, names):
    """A text with its true sentences."""
    joint, nouns, made = LANGUAGES[lang]
    low = lang not in ("ja", "zh", "th") and rng.random() < 0.1
    text, spans = "", []
    for _ in range(rng.randrange(2, 9)):
        s = rng.choice(made)
        while "{" in s:
            for mark, value in (("{N}", rng.choice(names)), ("{d}", str(rng.randrange(1, 99))), ("{w}", rng.choice(nouns.split()))):
                s = s.replace(mark, value, 1)
        s += rng.choice(ENDS.get(lang, "..!")) if lang != "th" else ""
        s = s[0].lower() + s[1:] if low else s
        if text:
            text += rng.choice([joint] * 12 + ["\n", "\n\n", "  " if lang != "zh" else "　"])
        spans.append((len(text), len(text) + len(s)))
        text += s
    return text, spans


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(11)
    made = [_document(rng, lang, NAMES[::2])[0] for lang in LANGUAGES for _ in range(300)]
    _, counts, classes = train(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    return counts, classes


@pytest.mark.parametrize("lang", LANGUAGES)
def test_held_out_accuracy(model, lang):
    """Other texts with names that the model has not seen."""
    rng = random.Random(5)
    hit = made = true = 0
    docs = [_document(rng, lang, NAMES[1::2]) for _ in range(200)]
    for (_, spans), got in zip(docs, sentences_of([t for t, _ in docs], *model)):
        hit, made, true = hit + len(set(got) & set(spans)), made + len(got), true + len(spans)
    assert hit / made > 0.97 and hit / true > 0.97, (lang, hit, made, true)


def cut(text, model):
    return [text[a:b] for a, b in sentences_of([text], *model)[0]]


@pytest.mark.parametrize(
    "parts",
    [
        ["The lamp works well.", "My aunt agrees!"],
        ["We paid for the strap and the seal.", "It weighs approx. 3.50 kg, i.e. less than the old lamp.", "My aunt agrees."],
        ['The leaflet says "Do not rinse. Wipe only." and nothing else.', "My aunt agrees."],
        ["It worked ... well, for 3 hours.", "Even the lamp has stayed on."],
        ["每个盖子都合适。", "老师也这么认为！"],
        ["店員は「止めて！漏れている！」と言っていました。", "同僚も同じ意見です。"],
        ["ฝาปิดสนิท", "ปุ่มปิดสนิท"],
        ["No mark at the end", "\n\nAnother paragraph\nwith a line break"],
        ["Geliefert wurde am 3. Mai gegen 9 Uhr.", "Inzwischen klemmt das Rohr."],
    ],
)
def test_cases(parts, model):
    joined = "" if any("぀" <= c <= "鿿" for c in parts[0]) else " "
    assert cut(joined.join(parts), model) == [p.strip() for p in parts]


def test_all_text_belongs_to_one_sentence(model):
    for text in ["  A. B!?  (c) \" d.\n\n e… “f. g” \t.　。。 x", ".", "\"", ". .", "a \n\n", "）。」", "..." * 40, "“" * 30 + "a." + "”" * 29, "5", "​", "x\n \n\n y."]:
        spans = sentences_of([text], *model)[0]
        assert all(a < b <= c for (a, b), (c, _) in zip(spans, spans[1:] + [(len(text), 0)]))
        assert "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())
        assert not any(text[a].isspace() or text[b - 1].isspace() for a, b in spans)


def test_null_empty_blank_long_repeated_and_clashing(spark):
    long = "The old lamp works well. It was cheap! Would you buy it? We did. " * 500
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, long), (4, "x"), (None, "y")]
    some = ["The old lamp works well. It was cheap!", "It was cheap! Would you buy it?", "We did. The old lamp works well.", "Would you buy it? We did."]
    rows += [(6, t) for t in some * 10]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start_pos string")
    got = split_sentences(df).collect()
    assert sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in got if r.doc_id not in (5, 6)) == [(0, 0, 1), (4, 0, 1), (4, 0, 1)]
    assert sum(r.doc_id == 5 for r in got) == 2000
    assert split_sentences(df.limit(0)).count() == 0


def test_counts_do_not_depend_on_the_partitions(spark):
    rng = random.Random(3)
    made = [(i, _document(rng, "en", NAMES)[0]) for i in range(60)]
    one, many = (train(spark.createDataFrame(made, "doc_id long, text string").repartition(n)) for n in (1, 7))
    assert np.allclose(one[1], many[1]) and np.allclose(_gather(one[0]), one[1])
