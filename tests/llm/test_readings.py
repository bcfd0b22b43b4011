import json
from collections import Counter
from difflib import SequenceMatcher

import pytest

from quillmill.llm import mojibake as J
from quillmill.llm import readings as Q

#: Sentences of many languages and the encodings they are written in.
TEXTS = {
    "pl": ("Zażółć gęślą jaźń – świeże źródło wody płynie przez las, a chłopiec śpi w łóżku pod ścianą.", "utf-8 cp1250 iso8859-2"),
    "cs": ("Příliš žluťoučký kůň úpěl ďábelské ódy, když se v zimě vracel domů přes zamrzlé jezero.", "utf-8 cp1250 iso8859-2"),
    "hu": ("Árvíztűrő tükörfúrógép működik az őszi kertben, ahol a fű már nem nő olyan gyorsan.", "utf-8 cp1250 iso8859-2"),
    "tr": ("Pijamalı hasta yağız şoföre çabucak güvendi, çünkü gökyüzü açık ve güneş ışığı sıcaktı.", "utf-8 cp1254"),
    "de": ("Der zuständige Redakteur löscht über Nacht die größte Prüfung und schließt die Tür.", "utf-8 cp1252 cp850 mac_roman cp437"),
    "fr": ("L’élève a déjà préparé le dîner à côté de la fenêtre où la lumière était très belle.", "utf-8 cp1252 mac_roman"),
    "ru": ("Первая страница читает исходный текст без лишних правил и показывает результат.", "utf-8 cp1251 koi8-r cp866"),
    "uk": ("Перша сторінка читає початковий текст без зайвих правил, їхній зміст є цікавим.", "utf-8 cp1251 koi8-u"),
    "el": ("Η πρώτη σελίδα διαβάζει το αρχικό κείμενο χωρίς περιττούς κανόνες και δείχνει το αποτέλεσμα.", "utf-8 cp1253 iso8859-7"),
    "he": ("העמוד הראשון קורא את הטקסט המקורי ללא כללים מיותרים ומציג את התוצאה.", "utf-8 cp1255"),
    "ar": ("تقرأ الصفحة الأولى النص الأصلي دون قواعد زائدة وتعرض النتيجة للقارئ.", "utf-8 cp1256"),
    "zh": ("在多数情况下，章节结构定期更新原始文本，并反复比较页面内容。", "utf-8 gb18030"),
    "zt": ("繁體中文的圖書館與資料庫說明，請仔細閱讀這些規則。", "utf-8 big5"),
    "ja": ("日本語のテキストを読み込んで、文字化けを直すための簡単なテストです。", "utf-8 shift_jis euc_jp"),
    "ko": ("첫 번째 페이지는 원본 텍스트를 읽고 결과를 사용자에게 보여 줍니다.", "utf-8 euc_kr"),
    "th": ("หน้าแรกอ่านข้อความต้นฉบับและแสดงผลลัพธ์ให้ผู้อ่าน", "utf-8"),
}
OTHER = [
    "Bản dịch này được kiểm tra lại nhiều lần trước khi xuất bản.", "Þórður fór út á sjó með öðrum mönnum í gærkvöldi.", "Първата страница чете изходния текст без излишни правила.", "Gökyüzünde yıldızlar parlıyor.",
    "The brûlée revision scans a Málmö judge.", "El niño comió piñas en São Paulo, naïveté, coöperative.", "Žluťoučký kůň a Łódź, Ścibelund, Malmö, Čeněk.", "हिन्दी में एक वाक्य।", "32 µm at 32 °C ± 2° for £3, ½ of “it” – fine…", "ΑΒΓ διαβάζει, Привет, 中文, 한국어 – mixed.", "НОВЫЙ РАЗДЕЛ", "col·lecció i pàgina",
]


def misread(text, w, r):
    """The text as a reader sees it, or None where hardly anything is left."""
    try:
        data = text.encode(w)
    except UnicodeEncodeError:
        data = text.replace("–", "-").replace("’", "'").encode(w, "ignore")
    bad = "".join(Q.table(r)[b] for b in data) if r in Q.ONE_BYTE else data.decode(r, "replace")
    return data.decode(w), bad if bad.count("�") <= 0.1 * len(bad) else None


def likeness(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_all_pairs_are_restored_or_left():
    count = Counter()
    for text, writers in TEXTS.values():
        for w in writers.split():
            for r in (*Q.ONE_BYTE, "gb18030", "big5"):
                was, bad = misread(text, w, r)
                if bad is None or bad == was or w == r or {w, r} == {"cp1252", "latin-1"}:
                    continue
                got, hit = J.repair(bad)
                count["exact" if got == was else "left" if got == bad else "part"] += 1
                # what is not restored is not made worse
                assert got == was or likeness(got, was) >= likeness(bad, was), (w, r, got)
                assert "�" in bad or hit or got == bad
    assert count["exact"] >= 370 and count["part"] <= 10, count


@pytest.mark.parametrize("text", [*(t for t, _ in TEXTS.values()), *OTHER])
def test_correct_text_of_all_languages_stays(text):
    assert Q.reread(text) is None
    assert J.repair(text)[0] == text


def test_a_line_without_a_clear_reading_stays():
    gbk = "别名列表待定结果".encode("gb18030").decode("cp1252")
    assert J.repair(gbk)[0] == "别名列表待定结果"
    # a byte is missing: no whole reading, nothing made up
    broken = gbk[:3] + gbk[4:]
    assert J.repair(broken)[0] in (broken, "别名列表待定结果"[:1] + broken[2:]) or likeness(J.repair(broken)[0], broken) > 0.3


def test_edges_of_runs_are_kept():
    half = "章节结构定期更新原始文本".encode("gb18030")[1:].decode("cp1251", "replace")
    got, _ = J.repair(half)
    assert not half.startswith(got[1:]) or got == half
    assert J._decode(b"\xd0abc", "utf-8", True) == (1, 0, "abc") and J._decode(b"\xd0abc", "utf-8", False) is None


def test_json_keeps_all_but_the_affected_values():
    raw = '{"n": 1.10, "k": 1, "k": 2,\t"é": "RenÃ©e \\u2014 x", "o": ["ok\\/", "Ã¼ber", {"Ã©": null}], "e": "\\u00c3\\u00a9t\\u00c3\\u00a9"}'
    done, hit = J.repair_json(raw)
    assert hit and done == raw.replace("RenÃ©e \\u2014 x", "Renée — x").replace("Ã¼ber", "über").replace("\\u00c3\\u00a9t\\u00c3\\u00a9", "été")
    assert json.loads(done)["o"][2] == {"Ã©": None}
    fine = '{"t":  "Größe", "x": 1.50}'
    assert J.repair_json(fine) == (fine, False)


def test_mixed_lines_are_restored_in_part():
    bad = "".join(Q.table("cp1252")[b] for b in "διαβάζει".encode())
    assert J.repair(f"Größe und {bad} – fein")[0] == "Größe und διαβάζει – fein"
    sentence = "Первая страница читает исходный текст."
    garbled = sentence.encode("cp1251").decode("cp1252")
    assert J.repair(f"中文内容很好。 {garbled} Ende gut.")[0] == f"中文内容很好。 {sentence} Ende gut."


def test_worth():
    assert Q.worth("") == Q.worth("plain") == Q.Worth(1.0, 0.0, "", 0)
    good, bad = Q.worth("Первая страница"), Q.worth("оЕПБЮЪ ЯРПЮМХЖЮ")
    assert good.good == 1 and bad.good < 0.6 and good.script == "cyrillic"
    assert Q.reread("é") is None and Q.reread("\xa0\x85") is None
    assert Q.reread("Ð" * 5000) is None
