"""Garbled text: found and restored, and sound text left alone."""

import pytest

from millrace.llm import mojibake as m
from millrace.llm.queries import QUERIES

from languages import ARTICLE, SAMPLES

TEXTS = {
    "de": "Die \xdcbersicht pr\xfcft gr\xf6\xdfere L\xfccken f\xfcr die n\xe4chste Zeile.",
    "fr": "L’\xe9l\xe8ve a r\xe9p\xe9t\xe9 la premi\xe8re le\xe7on tr\xe8s t\xf4t.",
    "es": "La se\xf1al a\xf1adi\xf3 tres n\xfameros despu\xe9s de ma\xf1ana.",
    "pl": "Gł\xf3wny moduł dołącza błęd\xf3w wątek.",
    "ru": "Новый отчёт проверяет старые строки каждый раз.",
    "tr": "Yeni \xe7alışma sınır aşılınca değeri g\xf6steriyor.",
    "ja": "夜間のレポートは毎回記録します。",
    "en": "He said “done” — and it’s 5 → 6…",
}
UTF8 = [(k, d) for k in TEXTS for d in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251") if not (k == "ja" and d in ("cp437", "mac_roman", "cp1251"))]
SINGLE = [("de", "cp1252", "mac_roman"), ("de", "cp1252", "cp437"), ("de", "cp1252", "cp1251"), ("es", "cp850", "cp1252"), ("pl", "cp1250", "cp1252"), ("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1251"), ("tr", "cp1254", "cp1252"), ("fr", "cp1252", "mac_roman")]


@pytest.mark.parametrize("lang, codec", UTF8)
def test_utf8_read_wrongly(lang, codec):
    bad = m.read_wrongly(TEXTS[lang].encode(), codec)
    assert m.restore(f"plain words. {bad}") == (True, f"plain words. {TEXTS[lang]}")


@pytest.mark.parametrize("lang", ["de", "en", "fr"])
@pytest.mark.parametrize("times", [2, 3])
def test_more_than_once(lang, times):
    bad = TEXTS[lang]
    for _ in range(times):
        bad = m.read_wrongly(bad.encode(), "cp1252")
    assert m.restore(bad) == (True, TEXTS[lang])


@pytest.mark.parametrize("lang, written, read", SINGLE)
def test_single_byte_encodings(lang, written, read):
    bad = m.read_wrongly(TEXTS[lang].encode(written, "replace"), read)
    found, new = m.restore(f"Some plain line.\n{bad}\nAnd another.")
    assert found
    right = TEXTS[lang].split()
    assert sum(a == b for a, b in zip(new.split("\n")[1].split(), right)) >= len(right) - 1


def test_in_places():
    text = f"{TEXTS['ru']}\n{TEXTS['fr']}\n"
    bad = text + m.read_wrongly(TEXTS["de"].encode(), "cp1252") + "\n" + TEXTS["ja"]
    assert m.restore(bad) == (True, text + TEXTS["de"] + "\n" + TEXTS["ja"])


@pytest.mark.parametrize("lang, codec", [("ru", "gbk"), ("ru", "cp932"), ("fr", "gbk"), ("fr", "big5"), ("de", "cp932"), ("de", "gbk"), ("es", "cp949"), ("pl", "cp949"), ("tr", "cp932")])
def test_utf8_read_as_east_asian(lang, codec):
    words = TEXTS[lang].replace("。", "").split()
    bad = []
    for w in words:
        try:
            bad.append(w.encode().decode(codec))
        except UnicodeDecodeError:  # such a word loses characters, so it isn't restored
            bad.append("word")
    right = [w if b != "word" else b for w, b in zip(words, bad)]
    assert sum(b != w for b, w in zip(bad, right)) >= 1
    assert m.restore(f"plain words. {' '.join(bad)}") == (True, f"plain words. {' '.join(right)}")


@pytest.mark.parametrize("text", ["用git录入数据，再用Python写。", "今日は良い天気です。テストを書きます。", "설정 파일을 다시 읽습니다.", "我們在這裡測試程式碼，請稍候。", "中文"])
def test_east_asian_text_is_sound(text):
    assert m.restore(text) == (False, text)


def test_lost_characters():
    found, new = m.restore("gr��ere L�cken")
    assert found and new == "gr��ere L�cken"
    assert m.restore("繧エ 縺� 繝・")[0]


@pytest.mark.parametrize("text", [*TEXTS.values(), "", None, "plain", "It should read \xfcber, not `\xc3\xbcber`.", "├── src/\n│   └── x  \xa9 2021", "√2 ≈ 1.414 \xa9 \xae ™ \xb5 \xb0 \xb1 \xbf…? \xc2∙B \xc3", "A FUN\xc7\xc3O OMITE AMANH\xc3", "\xdeessi skr\xe1 geymir b\xe1\xf0um", "m\xb2 m\xb3 \xbd", "文字"])
def test_sound(text):
    assert m.restore(text) == (False, text)


def test_rows(spark, small):
    bad = m.read_wrongly(TEXTS["de"].encode(), "cp1252")
    df = spark.createDataFrame([(1, bad, "z"), (1, bad, "z"), (2, None, "z"), (3, "", "z"), (None, bad, "z"), (4, "x" * 200_000 + "\xe9" + bad, "z")], "doc_id bigint, text string, restored string")
    got = m.repaired(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "4", "None"] and all(r.restored.endswith(TEXTS["de"]) for r in got)
    assert m.repaired(df.where("false")).isEmpty()
    assert QUERIES["p9_found"](spark, small).columns == ["doc_id"]


@pytest.mark.parametrize("lang", ["fr", "pt"])
def test_capitals_are_sound(lang):
    text = {"fr": "L’AGENT DÉLÉGUÉ RÉÉCRIT L’ÉLÉMENT, LES DONNÉES PÉRIMÉES ET LA CLÉ RÉSERVÉE", "pt": "A FUNÇÃO NÃO OMITE AS INFORMAÇÕES, AMANHÃ ÀS TRÊS"}[lang]
    assert m.restore(text) == (False, text)


def test_japanese_read_as_western():
    for written, read in (("cp932", "cp1252"), ("euc_jp", "latin-1")):
        bad = m.read_wrongly(TEXTS["ja"].encode(written), read)
        found, new = m.restore(f"words.\n{bad}\n")
        assert found and sum(a == b for a, b in zip(new, f"words.\n{TEXTS['ja']}\n")) > 0.8 * len(new)


@pytest.mark.parametrize("lang", ARTICLE)
def test_languages_are_sound(lang):
    assert m.restore(ARTICLE[lang]) == (False, ARTICLE[lang])


@pytest.mark.parametrize("text", SAMPLES)
def test_formulas_and_names_are_sound(text):
    assert m.restore(text) == (False, text)


def test_all_languages_on_one_page():
    page = "\n".join([*ARTICLE.values(), *SAMPLES])
    assert m.restore(page) == (False, page)


@pytest.mark.parametrize("times", range(4, 10))
def test_many_times(times):
    bad = text = "Größe für alle — “schön”"
    for _ in range(times):
        bad = m.read_wrongly(bad.encode(), "cp1252")
    assert m.restore(bad) == (True, text)


def _restored(right: str, new: str) -> tuple[int, int]:
    """How many words beyond ASCII came back, and how many there are."""
    a, b = right.split(), new.split()
    beyond = [k for k, w in enumerate(a) if not w.isascii()]
    return sum(a[k] == b[k] for k in beyond) if len(a) == len(b) else 0, len(beyond)


def test_recall_of_utf8():
    """UTF-8 of 50 languages read as one of the 15 encodings: nearly all found, most words back."""
    found = words = back = 0
    cases = [(x, d) for x in ARTICLE.values() for d in m.READ_AS]
    for text, d in cases:
        bad, new = m.restore(m.read_wrongly(text.encode(), d))
        found += bad
        a, b = _restored(text, new)
        back, words = back + a, words + b
    assert found >= 0.99 * len(cases) and back >= 0.94 * words


LEGACY = {
    "cp1252": "en de fr es pt it nl da no sv fi is ca ga sq", "cp1250": "pl cs sk hu hr sl ro", "iso8859-2": "pl cs sk hu hr sl", "cp1254": "tr", "cp1251": "ru uk bg sr mk", "koi8-r": "ru", "cp866": "ru", "cp1253": "el",
    "cp1255": "he", "cp1256": "ar", "cp874": "th", "gbk": "zh", "big5": "zh-tw", "cp949": "ko", "cp932": "ja", "euc_jp": "ja", "cp850": "de fr es", "cp437": "de fr es", "mac_roman": "de fr es pt it",
}


@pytest.mark.parametrize("written", LEGACY)
def test_recall_of_other_encodings(written):
    found = cases = 0
    for lang in LEGACY[written].split():
        text = ARTICLE[lang].encode(written, "ignore").decode(written)
        for read in m.READ_SCRIPTS[:3] if lang in ("he", "ar", "th", "el") else ("cp1252", "latin-1", "mac_roman", "cp1251", "koi8-r"):
            bad = m.read_wrongly(text.encode(written), read)
            if bad != text and read != written and (written, read) != ("cp1252", "latin-1"):
                found += m.restore(bad)[0]
                cases += 1
    assert found >= 0.75 * cases


@pytest.mark.parametrize("written, read, lang", [("gbk", "cp1252", "zh"), ("big5", "cp1252", "zh-tw"), ("cp949", "cp1252", "ko"), ("cp949", "mac_roman", "ko"), ("cp932", "cp1252", "ja"), ("euc_jp", "latin-1", "ja"), ("cp866", "cp1252", "ru"), ("cp1251", "cp1252", "ru"), ("koi8-r", "cp1252", "ru")])
def test_restored_whole(written, read, lang):
    text = ARTICLE[lang].encode(written, "ignore").decode(written)
    found, new = m.restore(m.read_wrongly(text.encode(written), read))
    a, b = _restored(text, new)
    assert found and a >= 0.9 * b


def test_nothing_is_dropped():
    raw = TEXTS["ja"].encode("euc_jp")
    new = m.restore(m.read_wrongly(raw[:-1], "latin-1"))[1]
    assert new[:-1] == TEXTS["ja"][:-1] and new[-1] == "\xa1"
    new = m.restore(m.read_wrongly(TEXTS["ja"].encode("cp932").replace(b"\x83\x8c", b"\x83"), "cp1252"))[1]
    assert "\ufffd" not in new


@pytest.mark.parametrize("written", ["cp437", "cp866"])
@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp1250"])
def test_drawn_lines(written, read):
    tree = "src/\n├── a.py\n│   ├── b.py\n│   └── c.md\n└── d  done"
    assert m.restore(m.read_wrongly(tree.encode(written), read)) == (True, tree)
