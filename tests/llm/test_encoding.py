from collections import Counter

import pytest

from leafmill.llm.encoding import Frequencies, read_lattice, restore, restore_chunks, rough_repair
from leafmill.llm.vocabulary import frequent, term_counts, terms

SOUND = [
    "Der Wartungsbericht bestätigt die übrigen Maßnahmen für das Außenlager, während die Prüfung läuft.",
    "La première étagère protège les délais révisés, à l'étage inférieur – “déjà” vérifié.",
    "Según lo previsto, el año próximo añade la señal más pequeña; ¿está dañada?",
    "Старый журнал подтверждает устаревшие инструкции без предупреждения.",
    "维护报告批准了设备的最新的安全通知，尽管标签上写着号码。",
    "ATENÇÃO: NÃO ABRIR. ÂGE ET ÉTAT DU DOSSIER. The client’s café costs €490 at 27 °C.",
]
FREQ = Frequencies(dict(Counter(w for t in SOUND * 5 for w in terms(t))))
CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1250")]


def garble(text, wrote, read):
    return text.encode(wrote).decode(read)


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_is_left_alone(text):
    assert restore(text, FREQ) == (text, False, True) and rough_repair(text) == text


@pytest.mark.parametrize("wrote,read", CHAINS)
@pytest.mark.parametrize("text", SOUND[:3])
def test_round_trip(text, wrote, read):
    try:
        bad = garble(text, wrote, read)
    except UnicodeDecodeError:
        pytest.skip("a byte has no character there")
    assert restore(bad, FREQ) == (text, True, True)


def test_twice_and_in_places():
    twice = garble(garble(SOUND[0], "utf-8", "latin-1"), "utf-8", "latin-1")
    assert restore(twice, FREQ) == (SOUND[0], True, True)
    mixed = SOUND[4] + "\n" + garble(SOUND[2], "utf-8", "cp1252") + "\n" + SOUND[3]
    assert restore(mixed, FREQ)[0] == SOUND[4] + "\n" + SOUND[2] + "\n" + SOUND[3]


@pytest.mark.parametrize("wrote,read", [("cp1251", "latin-1"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("utf-8", "cp1251")])
def test_russian(wrote, read):
    bad = SOUND[3].encode(wrote).decode(read, "replace")
    got, garbled, _ = restore(bad, FREQ)
    assert garbled and (got == SOUND[3] or "�" in bad)


def test_chinese():
    assert restore(garble(SOUND[4], "gbk", "latin-1"), FREQ)[0] == SOUND[4]
    bad = SOUND[4].encode().decode("gbk", "replace")
    got, garbled, complete = restore(bad, FREQ)
    same = sum(a == b for a, b in zip(got, SOUND[4]))
    assert garbled and not complete and same > 0.8 * len(SOUND[4])


def test_lost_bytes_are_filled_from_frequencies():
    assert restore("w�hrend die Pr�fung", FREQ)[:2] == ("während die Prüfung", True)
    bytes_ = list("für".encode())
    bytes_[2] = None
    assert read_lattice(bytes_, FREQ) == "für"
    assert restore("The client鈥檚 caf茅", FREQ)[:2] == ("The client’s café", True)


def test_restore_chunks(spark):
    bad = garble(SOUND[1], "utf-8", "cp1252") if False else garble(SOUND[0], "utf-8", "latin-1")
    rows = [(i, t, "x") for i, t in enumerate(SOUND * 3)] + [(100, bad, "x"), (100, bad, "x"), (101, None, "x"), (102, "", "x"), (103, "plain", "x")]
    got = restore_chunks(spark.createDataFrame(rows, "id long, content string, complete string")).collect()
    assert [(r.id, r.complete, r.content) for r in got] == [(100, True, SOUND[0])]
    assert restore_chunks(spark.createDataFrame([], "id long, content string")).count() == 0


def test_frequent_is_bounded(spark):
    df = spark.createDataFrame([("a1 common common common rare",)] * 10 + [(None,), ("",)], "content string")
    counts = term_counts(df, "content")
    assert {r.word: r.n for r in counts.collect()} == {"common": 30, "rare": 10}
    assert [r.word for r in frequent(counts, 2).collect()] == ["common"]


def test_any_number_of_lost_letters_and_joint_choice():
    """No bound on the lost letters of a word, and two losses of one word are decided together."""
    words = {"präöüßëñçõë": 9, "ängström": 50, "ånde": 500, "und": 900, "der": 900}
    freq = Frequencies(words)
    lost = "pr" + "�" * 9
    assert restore(f"der {lost} und", freq)[0] == "der präöüßëñçõë und"
    bad = "der ängström und".encode().replace(b"\xa4", b"\xff").replace(b"\xb6", b"\xff").decode("latin-1").replace("\xff", "�")
    assert restore(bad, freq) == ("der ängström und", True, False)


def test_the_likeliest_channel_is_taken():
    """A line that two undoings could explain is read as the corpus has it; one that no undoing makes likelier stays."""
    freq = Frequencies(dict(Counter(w for t in SOUND * 50 for w in terms(t))) | {"планировалось": 40, "комиссия": 40, "как": 90})
    bad = "как планировалось, комиссия".encode("cp1251").decode("latin-1")
    assert restore(bad, freq)[0] == "как планировалось, комиссия"
    assert freq.likelihood("la señal está dañada") > freq.likelihood("la seÃ±al estÃ¡ daÃ±ada") and freq.likelihood("� x") < freq.likelihood("é x")
    for text in ("Ångström & Ørsted", "naïve café", "ÄÖÜ ß"):
        assert restore(text, freq)[0] == text


def test_rare_words_are_looked_up_in_the_whole_corpus(spark):
    """With a bound so small that no word with an accent is sent to the tasks, lost letters are filled all the same."""
    text = "the report of the Böxdörfer Straße was read"
    rows = [(i, text + " and the old one of the office too") for i in range(5)] + [(i, "the and the of the and of the") for i in range(10, 40)]
    rows += [(90, "the B�xd�rfer and the B�XD�RFER"), (91, "the xx�yy of the office"), (92, "the BÃ¶xd" + "Ã�" + "rfer")]
    df = spark.createDataFrame(rows, "id long, content string")
    got = {r.id: r.content for r in restore_chunks(df, bound=20).collect()}
    assert got[90] == "the Böxdörfer and the BÖXDÖRFER" and set(got) == {90, 91, 92} and got[92] == "the Böxdörfer"
    assert {r.id for r in restore_chunks(df, bound=20, rare=False).collect()} == {90, 91, 92}


def test_signs_of_private_use_are_left_alone():
    for text in ("icon  and naïve ", "a ﷐ é"):
        assert restore(text, FREQ)[:2] == (text, False)
    assert restore("icon  f�r", FREQ)[0] == "icon  für"
