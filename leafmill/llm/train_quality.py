"""Fits the rule list of :mod:`leafmill.llm.quality` to documents whose kind is known because they were made (:mod:`leafmill.llm.label_texts`).

python -m leafmill.llm.train_quality TABLES

takes sentences from the documents at TABLES as material, makes labelled documents of them, computes their statistics, induces the rules by incremental reduced-error pruning
on two thirds, measures them on a sixth and, where TABLES has them, on the documents of ``quality_truth.json``: those were labelled by reading and
serve no other purpose. It writes ``quality_rules.json``.
"""

from __future__ import annotations

import json
import re
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.label_texts import made
from leafmill.llm.quality import FEATURES, MODEL, classify, statistics
from leafmill.llm.rules import Rule, apply, dump, induce

TRUTH = Path(__file__).with_name("quality_truth.json")
#: Documents that are made, and sentences of material, at most.
DOCUMENTS, SENTENCES = 15_000, 20_000
#: Scripts and marks that tell languages of material apart well enough to keep them together.
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*(?=[A-ZÀ-ÞА-Я¿¡㐀-鿿])")


def fit(x: dict[str, np.ndarray], labels: np.ndarray, seed: int = 7, attempts: int = 12) -> tuple[list[Rule], float]:
    """Rules from two thirds of the rows, and their accuracy on a sixth.

    Which rows grow a rule and which prune it is drawn at random, so several lists are induced; the one that is right most often on another sixth is taken.
    """
    part = np.random.default_rng(seed).random(len(labels))
    train, choose, test = part < 4 / 6, (part >= 4 / 6) & (part < 5 / 6), part >= 5 / 6
    right = lambda rules, at: float((apply(rules, {k: v[at] for k, v in x.items()}, "prose") == labels[at]).mean())
    # random signs may look like rows, and rows of cells are also short lines
    lists = [induce({k: v[train] for k, v in x.items()}, labels[train], "prose", seed + i, least=0.8, order=("code", "junk", "table", "list")) for i in range(attempts)]
    rules = max(lists, key=lambda r: right(r, choose))
    return rules, right(rules, test)


def material(documents: DataFrame) -> dict[str, list[str]]:
    """Sentences of labelled documents by language: seven words or more (fourteen characters in Chinese), a full stop at the end, nothing but letters and common signs. A bounded sample by hash."""
    rows = documents.filter("text IS NOT NULL").select(F.substring(F.lower("lang"), 1, 2).alias("lang"), "text").filter("lang IN ('en','de','fr','es','pt','ru','zh')").orderBy(F.xxhash64("text")).limit(1500).collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        for s in _SENTENCE.split(r.text.replace("\n", " ")):
            s = s.strip()
            long = len(s) >= 14 if re.search("[㐀-鿿]", s) else len(s.split()) >= 7
            if long and len(s) < 300 and re.fullmatch(r"[\w\s,;:.!?'’“”«»„()€%°，。；：！？、“”（）¿¡–/#-]+[.!?。！？]", s):
                out.setdefault(r.lang, []).append(s)
    most = SENTENCES // 7
    return {k: sorted(set(v))[:most] for k, v in out.items()}


def main(tables: str) -> None:
    from leafmill.session import build
    from leafmill.sources.tables import load

    spark = build("train", "local[*]")
    documents = made(material(load(spark, tables, "documents")), DOCUMENTS)
    df = spark.createDataFrame([(i, 0, text) for i, (_, text) in enumerate(documents)], "document_id long, chunk_index int, content string").repartition(16)
    rows = statistics(df).toPandas().sort_values("document_id")
    y = np.array([kind for kind, _ in documents], object)[rows["document_id"]]
    rules, accuracy = fit({f: rows[f].to_numpy(float) for f in FEATURES}, y)
    report = {"held_out_accuracy": round(accuracy, 4), "documents": len(y)}
    MODEL.write_text(json.dumps(report | {"rules": dump(rules)}, indent=1) + "\n")
    truth = {int(k): v for k, v in json.loads(TRUTH.read_text()).items()}
    wanted = spark.createDataFrame([(k,) for k in truth], "document_id long")
    told = {r.document_id: r.text_kind for r in classify(statistics(load(spark, tables, "chunks").join(wanted, "document_id", "left_semi"))).collect()}
    wrong = {k: (truth[k], v) for k, v in told.items() if truth[k] != v}
    if told:
        report |= {"read_documents": len(told), "right_of_read": round(1 - len(wrong) / len(told), 4)}
        MODEL.write_text(json.dumps(report | {"rules": dump(rules)}, indent=1) + "\n")
    print(MODEL.read_text(), wrong)


if __name__ == "__main__":
    main(sys.argv[1])
