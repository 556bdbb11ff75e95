import random

import pytest

from neurolith.llm import encoding as en

SOUND = {
    "de": "Die Messung über der rechten Schläfe ergab größere Störungen als üblich, daher wurde sie für Gerät {n} verkürzt.",
    "fr": "Après la séance, l’écart entre les deux tâches était inférieur à {n} µM chez les élèves âgés.",
    "es": "Durante la sesión {n}, la señal de la región izquierda subió más que después de la corrección.",
    "ru": "При {n} °C дрейф левой лобной области составил больше, чем показывал прибор во время записи.",
    "zh": "在心算任务期间，右侧运动区的氧合血红蛋白上升了{n}个单位，老年志愿者的记录因重新佩戴光极帽而推迟。",
    "en": "The café noise outside room {n} didn’t affect the signal – a drift of 2 °C was visible.",
}
CLAUSES = "在心算任务期间 右侧运动区的氧合血红蛋白上升了 老年志愿者的记录因重新佩戴光极帽而推迟 请检查额中线区域的增益 采样率设为十赫兹 设备导出的文件中有很多事件 操作人员在日志中写道 枕叶通道没有出现明显变化 本节说明如何提取窗口 基线校正之后准确率下降".split()


def sentence(lang, n):
    """A text of a language; Chinese ones in changing orders, so that no garbled text occurs twice."""
    if lang != "zh":
        return SOUND[lang].format(n=n)
    rng = random.Random(n)
    return "，".join(rng.sample(CLAUSES, 5)) + f"{n}。"


SWAPS = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("es", "utf-8", "mac_roman"), ("ru", "utf-8", "cp1251"), ("ru", "koi8-r", "cp1251"), ("zh", "gb18030", "cp1252"), ("de", "cp1252", "cp850"), ("zh", "gb18030", "big5"), ("en", "utf-8", "cp437"), ("es", "utf-8", "gb18030")]


def swap(text, true, read):
    raw = text.encode(true)
    if read in ("cp1252", "latin-1"):  # undefined bytes show as controls
        back = {b: c for c, b in en.to_bytes("cp1252" if read == "cp1252" else "cp1252").items()} if read == "cp1252" else {b: b for b in range(256)}
        return "".join(chr(back.get(b, b)) for b in raw)
    return raw.decode("gbk" if read == "gb18030" else read, "replace")


@pytest.fixture(scope="module")
def table(spark):
    rows = [("chunks", f"{lang}{n}", "chunks/a", sentence(lang, n)) for lang in SOUND for n in range(60)]
    bad = {}
    for k, (lang, true, read) in enumerate(SWAPS):
        for n in range(4):
            good = sentence(lang, 900 + n)
            bad[f"x{k}-{n}"] = (swap(good, true, read), good)
    rows += [("chunks", i, "chunks/b", t) for i, (t, _) in bad.items()]
    rows += [("chunks", f"q{n}", "chunks/b", f"If the export {n} shows “Ã¼” where “ü” was typed, open it again.") for n in range(5)]
    rows += [("chunks", f"p{n}", "chunks/b", f"Older exports {n} print Â° instead of °; the stored copy is fine.") for n in range(5)]
    rows += [("paper_materials", "lost", "paper_materials", "Gr��ere Spr�nge"), ("paper_materials", "wide", "paper_materials", "T\0h\0e\0 \0e\0n\0d\0"), ("chunks", "math", "chunks/a", "𝛥𝜇 🧠 naïve")]
    return bad, spark.createDataFrame(rows, "table_name string, record_id string, source string, text string")


def test_garbled_records_are_found_and_restored(table):
    bad, df = table
    got = {r.record_id: r for r in en.garbled(df).collect()}
    assert set(got) == set(bad) | {"lost", "wide"}
    exact = [got[i].restored == good for i, (shown, good) in bad.items() if "�" not in shown]
    assert sum(exact) >= 0.9 * len(exact) and len(exact) >= 24
    assert got["wide"].restored == "The end" and got["lost"].swap is None


def test_several_layers_come_off():
    twice = "Größe".encode().decode("cp1252").encode().decode("cp1252")
    assert en.undo_all(twice[2:-1], ("cp1252", "utf_8")) is not None
    k = en.SWAPS.index(("cp1252", "utf_8"))
    assert en.undo_all("Ã¼", en.SWAPS[k]) == "ü" and en.undo_all("ÃƒÂ¼", en.SWAPS[k]) == "ü"
    assert en.undo("é", ("cp1252", "utf_8")) is None and en.undo("中", ("cp1252", "utf_8")) is None


def test_every_single_byte_swap_is_a_cipher():
    for read in en.SINGLE:
        for true in en.SINGLE:
            table = en.cipher(read, true)
            assert all(to in en.to_chars(true).values() for to in table.values())
            if read == true:
                assert all(a == b for a, b in table.items() if not 0x80 <= a < 0xA0)


def test_nulls_empty_and_repeated(spark):
    c = spark.createDataFrame([(None, "s", "x"), ("a", None, None), ("b", "s/t", ""), ("c", "s/t", "plain"), ("c", "s/t", "plain")], "chunk_id string, source string, content string")
    m = spark.createDataFrame([("m", "Gr�n", 1), ("m", "Gr�n", 2)], "material_id string, paper_text string, text int")
    assert [(r.table_name, r.record_id) for r in en.garbled(en.texts_of(c, m)).collect()] == [("paper_materials", "m")]
    assert en.garbled(en.texts_of(c.limit(0), m.limit(0))).count() == 0


def test_very_long_text(spark):
    long = SOUND["de"].format(n=1) * 3000
    df = spark.createDataFrame([("chunks", "l", "s", long), ("chunks", "g", "s", swap(long, "utf-8", "cp1252"))], "table_name string, record_id string, source string, text string")
    assert [r.record_id for r in en.garbled(df).collect()] in (["g"], [])  # one half against the other: never the sound one


def test_a_text_delivered_again_and_again_is_not_learned_as_language(spark):
    rows = [("chunks", f"{lang}{n}", "chunks/a", sentence(lang, n)) for lang in SOUND for n in range(30)]
    bad = swap(sentence("ru", 900), "koi8-r", "cp1251")
    rows += [("chunks", "again", "chunks/b", bad)] * 600
    df = spark.createDataFrame(rows, "table_name string, record_id string, source string, text string")
    assert [(r.record_id, r.restored) for r in en.garbled(df).collect()] == [("again", sentence("ru", 900))]


@pytest.fixture(scope="module")
def model(table):
    return en.learn(table[1].select("source", "text"))


def test_every_garbled_stretch_of_a_record_is_restored(model):
    one, two = sentence("ru", 901), sentence("es", 902)
    shown = f"{swap(one, 'koi8-r', 'cp1251')}\n{swap(two, 'utf-8', 'mac_roman')}"
    found, restored, swaps = en.judge(model, "chunks/b", shown)
    assert found and restored == f"{one}\n{two}" and set(swaps.split("+")) == {"cp1251/koi8_r", "mac_roman/utf_8"}


def test_stretches_beside_nulls_are_restored(model):
    german = sentence("de", 903)
    _, restored, swaps = en.judge(model, "chunks/b", "T\0h\0e\0 \0e\0n\0d\0\u2028" + swap(german, "utf-8", "cp1252"))
    assert restored == "The end\u2028" + german and swaps == "cp1252/utf_16+cp1252/utf_8"


def test_what_survives_beside_lost_characters_is_restored(model):
    shown = swap(sentence("de", 904), "utf-8", "cp1252") + " Gr\u00c3\u00b6\ufffd und \u00c3\u00bcbe\ufffd \u00c3\u00a4\ufffd"
    assert en.beside_lost("\u00c3\u00a4\ufffd", 0, 2)
    found, restored, swaps = en.judge(model, "chunks/b", shown)
    assert found and restored == sentence("de", 904) + " Gr\u00f6\ufffd und \u00fcbe\ufffd \u00e4\ufffd" and swaps == "cp1252/utf_8"


RUSSIAN = "прибор показывал дрейф левой лобной области больше чем правой во время записи сигнал датчика был слабее обычного поэтому запись повторили после перерыва участник закрыл глаза и отдыхал измерение началось утром канал затылочной доли отключили из-за помех оператор отметил движение головы в журнале данные сохранили в общем архиве".split()
FRENCH = "après la séance l’écart entre les tâches était très inférieur à celui du début élève âgé fenêtre dégagée où le signal a été mesuré à côté de la région préfrontale première étape complète modèle entraîné répété même période".split()


def shuffled(words, n):
    rng = random.Random(n)
    return " ".join(rng.choice(words) for _ in range(28)).capitalize() + f" {n}."


def test_a_mapping_outside_the_list_is_learned_for_its_source(spark):
    assert not {"mac_cyrillic", "cp852", "cp775"} & {c for swap in en.SWAPS for c in swap}
    rows = [("chunks", f"{i}{n}", "chunks/a", shuffled(w, n)) for i, w in (("r", RUSSIAN), ("f", FRENCH)) for n in range(150)]
    rows += [("chunks", f"{lang}{n}", "chunks/a", sentence(lang, n)) for lang in ("de", "es", "zh", "en") for n in range(60)]
    # a page that nobody knows: the Cyrillic letters in an order of its own
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    own = dict(zip(letters, random.Random(4).sample("ĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĲĴĶĹĻĽĿŁ", len(letters)), strict=True))
    made = {"mac": lambda t: swap(t, "mac_cyrillic", "cp1252"), "own": lambda t: "".join(own.get(c, c) for c in t.lower())}
    bad = {}
    for name, garble in made.items():
        for n in range(80):
            good = shuffled(RUSSIAN, 1000 + n)
            bad[f"{name}{n}"] = (garble(good), good if name == "mac" else good.lower())
        rows += [("chunks", i, f"chunks/{name}", t) for i, (t, _) in bad.items() if i.startswith(name)]
        rows += [("chunks", f"sound-{name}{n}", f"chunks/{name}", shuffled(FRENCH, 2000 + n)) for n in range(20)]
    df = spark.createDataFrame(rows, "table_name string, record_id string, source string, text string")
    got = {r.record_id: r for r in en.garbled(df).collect()}
    assert set(got) == set(bad)
    common = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(b)
    for name in made:
        right = [common(got[i].restored, good) for i, (_, good) in bad.items() if i.startswith(name)]
        assert min(len(got[i].restored) == len(good) for i, (_, good) in bad.items()) and sum(right) / len(right) > 0.95
    assert {got[i].swap for i in bad if i.startswith("own")} == {"learned"}


def test_a_language_of_one_source_only_is_not_taken_for_garble(spark):
    rows = [("chunks", f"f{n}", "chunks/a", shuffled(FRENCH, n)) for n in range(120)] + [("chunks", f"d{n}", "chunks/a", sentence("de", n)) for n in range(60)]
    rows += [("chunks", f"r{n}", "chunks/ru", shuffled(RUSSIAN, n)) for n in range(120)]
    df = spark.createDataFrame(rows, "table_name string, record_id string, source string, text string")
    assert en.garbled(df).count() == 0
