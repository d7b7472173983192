import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import rules as R
from leafmill.llm.language import Model, _Labeller, codes, fit, label_segments, mislabelled, named, shares, words_of
from leafmill.llm.quality import classify, statistics, with_kind

EN = "The maintenance report confirms the delivery of the remaining boxes, because the earlier copy was damaged. "
DE = "Der Wartungsbericht bestätigt die Lieferung der übrigen Kisten, weil die frühere Kopie beschädigt war. "
FR = "Le rapport d'entretien confirme la livraison des autres boîtes, car la copie précédente était abîmée. "
ES = "El informe de mantenimiento confirma la entrega de las demás cajas, porque la copia anterior estaba dañada. "
PT = "O relatório de manutenção confirma a entrega das outras caixas, porque a cópia anterior estava danificada. "
RU = "Отчёт о ремонте подтверждает доставку остальных коробок, потому что прежняя копия была повреждена. "
ZH = "维护报告确认了其余的箱子已经送达，因为之前的副本已经损坏。"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_code string")


def corpus():
    rows = [(i * 10 + k, t * 3, code, "x") for i in range(20) for k, (t, code) in enumerate(((EN, "en"), (DE, "ger"), (FR, "French"), (ES, "es-MX"), (PT, "pt_BR"), (RU, "RU"), (ZH, "zh_Hans")))]
    return rows + [
        (1001, EN * 3, None, "x"), (1002, DE * 3, "en", "x"), (1003, EN * 3 + DE * 3, "en", "x"), (1004, EN + DE + EN + DE + EN + DE, "", "x"), (1005, None, None, "x"), (1006, "", "en", "x"),
        (1007, "short", None, "x"), (1008, "12345 " * 40, None, "x"), (1009, EN * 3, "en;de", "x"), (1010, EN * 3 + ZH * 9 + RU * 3, "zh", "x"), (1011, EN * 3, "it", "x"), (1012, (DE * 3).encode().decode("latin-1"), None, "x"),
    ]


def test_notations(spark):
    assert codes(["en", "EN-gb", "deu", "Français", "zh_Hans", "xx", None]) == ["en", "en", "de", "fr", "zh", None, None]
    df = documents(spark, [(1, "", "en, DE", ""), (2, "", None, ""), (3, "", "und", ""), (4, "", "ja", ""), (5, "", "pt-BR", "")])
    assert [r.n for r in df.orderBy("doc_id").select(named(df.lang).alias("n")).collect()] == [["en", "de"], [], [], ["other"], ["pt"]]
    assert words_of("Model HZ-3258 <b>über</b> 北方 https://a.b/c") == ["model", "über", "北方"]


def test_held_out_accuracy_without_training():
    """Seeds alone tell the languages of plain sentences."""
    labeller = _Labeller(Model({}))
    assert [labeller.segments(t)[0][2] for t in (EN, DE, FR, ES, PT, RU, ZH)] == ["en", "de", "fr", "es", "pt", "ru", "zh"]


def test_segments_and_labels(spark):
    df = documents(spark, corpus())
    model = fit(df)
    segments = label_segments(df, model).collect()
    by = {}
    for r in sorted(segments, key=lambda r: (r.doc_id, r.segment)):
        by.setdefault(r.doc_id, []).append(r)
    text = {r[0]: r[1] or "" for r in corpus()}
    for i, rows in by.items():
        assert rows[0].start == 0 and rows[-1].end == len(text[i]) and all(a.end == b.start for a, b in zip(rows, rows[1:]))
        assert all(0 <= r.confidence <= 1 for r in rows)
    assert set(by) == set(text)
    assert [r.lang_code for r in by[1004]] == ["en", "de"] * 3 and all(r.confidence > 0.9 for r in by[1004])
    assert abs(by[1003][0].end - 3 * len(EN)) <= 1 and [r.lang_code for r in by[1005]] == ["und"] and by[1008][0].confidence == 0.0
    part = {(r.doc_id, r.lang_code): r.share for r in shares(label_segments(df, model)).collect()}
    assert abs(part[1003, "en"] + part[1003, "de"] - 1) < 1e-9
    found = {}
    for r in mislabelled(df, model).collect():
        found.setdefault(r.doc_id, set()).add(r.lang_code)
    assert found == {1001: {"en"}, 1002: {"de"}, 1003: {"en", "de"}, 1004: {"en", "de"}, 1009: {"en"}, 1010: {"en", "zh", "ru"}, 1011: {"en"}, 1012: {"de"}}
    assert label_segments(df.limit(0), model).count() == 0 and mislabelled(df.limit(0)).count() == 0


def test_constant_path_equals_viterbi():
    """The shortcut for unmixed texts gives what the full search gives."""
    from leafmill.llm.language import LANGUAGES, SWITCH, _viterbi

    rng = random.Random(5)
    labeller = _Labeller(Model({}))
    for _ in range(30):
        text = "".join(rng.choice((EN, EN, EN, DE)) for _ in range(4))
        words = words_of(text)
        scores = labeller.rows[labeller.look(words)].astype(float)
        full = _viterbi(text, scores, list(range(len(LANGUAGES))))
        assert [s[2] for s in labeller.segments(text)] == [s[2] for s in full]
    assert SWITCH > 0


def test_rules_learn_and_export(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600), "noise": rng.random(600)}
    y = np.where(x["a"] > 0.7, "list", np.where((x["b"] < 0.2) & (x["a"] < 0.5), "junk", "prose")).astype(object)
    y[rng.random(600) < 0.02] = "prose"
    rules = R.induce({k: v[:400] for k, v in x.items()}, y[:400], "prose")
    test = {k: v[400:] for k, v in x.items()}
    assert (R.apply(rules, test, "prose") == y[400:]).mean() > 0.93
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in test.values()))), list(test))
    assert [r.k for r in df.selectExpr(f"{R.to_sql(rules, 'prose')} AS k").collect()] == R.apply(rules, test, "prose").tolist()
    assert R.parse(R.dump(rules)) == rules and R.to_sql([], "prose") == "'prose'"


def test_statistics_and_kinds(spark):
    rng = random.Random(1)
    items = ["the agreed payment terms", "a missing signature", "the cooling circuit for unit", "all open defects"]
    prose = (EN + "It goes on for a while, as text does. ") * 6
    listing = "\n".join(f"- {rng.choice(items)} {i}" for i in range(30))
    table = "\n".join(f"{rng.choice(items)} | {i * 7}% | {i}.5 | {i * 31}" for i in range(30))
    junk = "\n".join("".join(rng.choices("qwrtzpsdfghjklxcvbnm ", k=60)) for _ in range(20))
    code = "\n".join(f"    value_{i} = fold(split{i}, {i})\nif row_{i} > {i}:" for i in range(30))
    docs = {1: prose, 2: listing, 3: table, 4: junk, 5: code}
    rows = [(d * 10 + k, d, k, t[k * 400 : k * 400 + 400], "x") for d, t in docs.items() for k in range(-(-len(t) // 400))]
    rows += [rows[0], (900, 6, 0, None, "x"), (901, 7, 0, "", "x"), (902, None, 0, "text", "x")]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, content string, text_kind string")
    got = {r.document_id: r for r in classify(statistics(df)).collect()}
    assert {d: got[d].text_kind for d in docs} == {1: "prose", 2: "list", 3: "table", 4: "junk", 5: "code"}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[6].word_count == 0 and got[7].common_ratio == 0.0
    assert abs(got[1].word_count - len(prose.split())) <= 3 and 0.3 < got[1].common_ratio < 0.7 and got[2].mark_ratio > 0.9 and got[3].row_ratio > 0.9
    whole = spark.createDataFrame([(d, t) for d, t in docs.items()] + [(9, None)], "doc_id long, text string")
    assert {r.doc_id: r.text_kind for r in with_kind(whole, "text").collect() if r.doc_id < 9} == {1: "prose", 2: "list", 3: "table", 4: "junk", 5: "code"}
    assert statistics(df.limit(0)).count() == 0


def test_rules_on_documents_made_anew_and_on_documents_read(spark):
    """Held-out accuracy: on documents made from another seed out of a few sentences, and on those that were labelled by reading."""
    import json
    from pathlib import Path

    from leafmill.llm import label_texts, train_quality
    from leafmill.llm.quality import classify, statistics

    en = [f"The {a} of the {b} is checked before the {c} can start, because the old one was too slow." for a in ("pump", "filter", "report") for b in ("unit", "office", "plant", "branch") for c in ("test", "shift")]
    de = [f"Die {a} der {b} wird vor dem {c} geprüft, weil sie im letzten Jahr zu langsam war." for a in ("Pumpe", "Leitung", "Liste") for b in ("Anlage", "Stelle", "Halle", "Firma") for c in ("Start", "Ende")]
    made = label_texts.made({"en": en, "de": de}, 400, seed=99)
    assert made == label_texts.made({"de": de, "en": en}, 400, seed=99)
    df = spark.createDataFrame([(i, 0, t) for i, (_, t) in enumerate(made)], "document_id long, chunk_index int, content string")
    told = {r.document_id: r.text_kind for r in classify(statistics(df)).collect()}
    assert sum(told[i] == k for i, (k, _) in enumerate(made)) >= 0.96 * len(made)
    tables = Path("/root/testdata/sf0.1/chunks.parquet")
    if tables.exists():
        truth = {int(k): v for k, v in json.loads(train_quality.TRUTH.read_text()).items()}
        rows = classify(statistics(spark.read.parquet(str(tables)).filter(F.col("document_id").isin(list(truth))))).collect()
        assert len(rows) == len(truth) and sum(truth[r.document_id] == r.text_kind for r in rows) >= 0.98 * len(rows)


def test_a_filter_on_the_kind_does_not_repeat_the_counts(spark, tmp_path):
    """Each pattern is evaluated once a row, though the filter on the kind uses most of the counts several times."""
    from leafmill.llm.quality import _CODE

    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    spark.createDataFrame([(1, "The text."), (2, None)], "id long, text string").write.parquet(str(tmp_path / "t"))
    for asked in (None, ("code", "junk")):
        df = with_kind(spark.read.parquet(str(tmp_path / "t")), "text", asked).filter("text_kind NOT IN ('code', 'junk')").select("id")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(_CODE[:60]) == 1
        assert sorted(r.id for r in with_kind(spark.read.parquet(str(tmp_path / "t")), "text", asked).filter("text_kind = 'prose'").collect()) in ([1], [1, 2])
