"""Languages of documents and of the stretches within them (problem 10)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.encoding import rough_repair
from leafmill.llm.quality import with_kind

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "zh")
#: Languages that share the Latin script; the other two are told by script alone.
LATIN = LANGUAGES[:5]
#: Documents a label used for fitting (by hash of ``doc_id``, about).
SAMPLE_DOCS = 1000
#: What a change of language costs, in nats; and the most that one word can say for or against one.
SWITCH, MOST = 9.0, 3.0

# Other notations of the language codes (ISO 639-1, 639-2, English and own names).
NOTATIONS = {
    "en": "en eng english englisch anglais inglés ingles",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi chinese 中文 汉语 漢語 cn",
}
# A few common words a language, for words that no labelled document has.
SEEDS = {
    "en": "the of and to in a is that it for on are as with be this have from or by not but what all which their will has no been than may so after before because since under",
    "de": "der die das den dem des ein eine einer und ist im in zu von mit für auf nicht auch als an bei nach aus um wie oder wenn wird hat sich es noch nur vor durch über unter zum zur",
    "fr": "le la les un une des du de et est en dans que qui pour pas par sur au aux avec plus ce cette ses son sa il elle ne ou mais si sans sous entre depuis avant après",
    "es": "el la los las un una del de y en que por para con no se su lo como más pero sin sobre este ya hasta desde según aunque antes tras ha fue junto",
    "pt": "o a os as um uma do da dos das no na nos nas ao à e em que por para com não se seu sua mais mas sem sobre como já até desde segundo embora antes após foi pelo pela",
}
_CODES = {n: code for code, names in NOTATIONS.items() for n in names.split()}

HAN = r"㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{HAN}]+|(?<![\w-])[^\W\d_{HAN}]+(?!\w*-?\d)")
_IS_HAN, _IS_CYR = re.compile(f"[{HAN}]"), re.compile("[Ѐ-ӿ]")
#: Rough weight of a Chinese character against the letters that say the same.
_HAN_WORDS = 2.0


def named(label: Column) -> Column:
    """The language codes that a label names, whatever its notation; empty for none, NULL or others.

    Notations are split at commas, semicolons, slashes, ``+``, ``&`` and blanks; what follows ``-`` or ``_`` is a region
    or script. A name that is no language of :data:`LANGUAGES` yields ``other``.
    """
    parts = F.filter(F.split(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"[,;/+&\s]+"), lambda p: p != "")
    heads = F.transform(parts, lambda p: F.regexp_extract(p, r"^([^-_.]*)", 1))
    codes = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    unknown = F.array(*[F.lit(x) for x in ("und", "unknown", "none", "null", "n/a", "??", "?", "mul", "zxx")])
    return F.array_distinct(F.transform(F.filter(heads, lambda h: ~F.array_contains(unknown, h)), lambda h: F.coalesce(F.try_element_at(codes, h), F.lit("other"))))


_NOISE = re.compile(r"<[^<>\n]{1,300}>|https?://\S+|\]\([^)\s]*\)|&#?\w{1,10};|\\[A-Za-z]+\*?|\{\{[^{}|\n]*|\$[^$\n]{1,80}\$|\{\|[^\n]*")
_NOISY = re.compile(r"[<\\&${]|://|\]\(")


def prose(text: str) -> str:
    """``text`` in lower case with tags, addresses and commands blanked out; every character keeps its place."""
    low = text.lower()
    low = low if len(low) == len(text) else text
    return _NOISE.sub(lambda m: " " * len(m.group()), low) if _NOISY.search(low) else low


def words_of(text: str) -> list[str]:
    """Words in lower case: runs of Chinese characters, or of other letters not joined to digits; markup has none."""
    return _WORD.findall(prose(text))


class Model:
    """Log-likelihoods of words in the Latin-script languages; scripts decide for the rest.

    ``counts`` maps a language to word counts. A known word scores its smoothed log share in each
    language, levelled to the mean and limited to :data:`MOST`; an unknown one by its letter triples,
    at half weight.
    """

    def __init__(self, counts: dict[str, dict[str, int]]):
        k = len(LATIN)
        self.totals = np.array([sum(counts.get(c, {}).values()) + 1.0 for c in LATIN])
        self.table: dict[str, np.ndarray] = {}
        triples: list[Counter] = [Counter() for _ in LATIN]
        rows: dict[str, np.ndarray] = {}
        for j, c in enumerate(LATIN):
            for w, n in counts.get(c, {}).items():
                rows.setdefault(w, np.zeros(k))[j] += n
                for g in _triples(w):
                    triples[j][g] += min(n, 20)
        for w, row in rows.items():
            share = (row + 0.2) / (self.totals + 200.0)
            self.table[w] = _level(np.log(share) * min(1.0, 0.35 + row.sum() / 20))
        size = np.array([sum(t.values()) + 1.0 for t in triples])
        self.triples = {g: np.log((np.array([t[g] for t in triples]) + 0.5) / (size + 2000.0)) for g in set().union(*triples)}
        for j, c in enumerate(LATIN):
            for w in SEEDS[c].split():
                if w not in self.table:
                    own = np.array([1.0 if w in SEEDS[x].split() else 0.02 for x in LATIN])
                    self.table[w] = _level(np.log(own))

    def score(self, word: str) -> np.ndarray:
        """One score a language of :data:`LANGUAGES`."""
        out = np.full(len(LANGUAGES), -MOST)
        if _IS_HAN.match(word):
            out[6] = MOST
            return out * min(4.0, len(word) / _HAN_WORDS)
        if _IS_CYR.search(word):
            out[5] = MOST
            return out * min(1.0, len(word) / 3)
        if word in self.table:
            out[:5] = self.table[word]
            return out
        seen = [self.triples[g] for g in _triples(word) if g in self.triples]
        out[:5] = _level(0.5 * np.sum(seen, axis=0)) if len(seen) > 1 else 0.0
        if len(word) < 3:
            out[:5] = 0.0
        return out


def _triples(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _level(v: np.ndarray) -> np.ndarray:
    v = v - np.sort(v)[-2:].mean()
    return np.clip(v, -MOST, MOST)


def _sampled(documents: DataFrame, docs: int) -> DataFrame:
    """Labelled documents of one language, about ``docs`` a language, picked by hash so that a rerun picks the same."""
    one = documents.select("doc_id", "text", named(F.col("lang")).alias("codes")).filter("size(codes) = 1 AND get(codes, 0) <> 'other' AND text IS NOT NULL").select("doc_id", "text", F.get("codes", F.lit(0)).alias("code"))
    sizes = {r.code: r.n for r in one.groupBy("code").agg(F.count("*").alias("n")).collect()}  # one row a language
    part = F.create_map(*[F.lit(x) for c, n in (sizes or {"": 1}).items() for x in (c, min(1.0, docs / n))])
    return one.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) < F.try_element_at(part, F.col("code")) * float(1 << 30))


def _counted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Counter] = {}
        labeller = model and _Labeller(model)
        for batch in batches:
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if labeller is None:
                    own.setdefault(code, Counter()).update(words_of(text))
                else:
                    for s in labeller.segments(text):
                        own.setdefault(s[2], Counter()).update(words_of(text[s[0] : s[1]]))
        rows = [(c, w, n) for c, counter in own.items() if c in LATIN for w, n in counter.items() if not _IS_CYR.search(w) and not _IS_HAN.match(w)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["code", "word", "n"])

    return run


def fit(documents: DataFrame, docs: int = SAMPLE_DOCS) -> Model:
    """A model from about ``docs`` labelled documents a language, whole texts.

    Labels are noisy, so the first model labels the sample anew and the second is fitted to that. What comes to the
    driver are the words that stand more than once in that sample, which ``docs`` bounds; words seen once are scored by
    their letters like unknown ones. Without labelled documents the seeds decide.
    """
    sample = _sampled(documents, docs).select("code", "text")
    model: Model | None = None
    for _ in range(2):
        counted = sample.mapInArrow(_counted(model), "code string, word string, n long").groupBy("code", "word").agg(F.sum("n").alias("n")).filter("n > 1")
        found: dict[str, dict[str, int]] = {}
        for r in counted.collect():
            found.setdefault(r.code, {})[r.word] = r.n
        model = Model(found)
    return model


class _Labeller:
    """Applies a model, with a growing table of word scores."""

    LIMIT = 400_000

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGUAGES)), np.float32)

    def look(self, words: list[str]) -> list[int]:
        """Numbers of the words in the table; words not seen before are scored and added."""
        ids = self.ids
        out = list(map(ids.get, words))
        if None in out:
            for w in words:
                if w not in ids:
                    i = ids[w] = len(ids)
                    if i >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[i] = self.model.score(w)
            out = list(map(ids.__getitem__, words))
        return out

    def segments(self, text: str) -> list[tuple[int, int, str, float, int]]:
        return self.label([text])[0]

    def label(self, texts: list[str]) -> list[list[tuple[int, int, str, float, int]]]:
        """For each text its segments: start, end, language, confidence, letters (a Chinese one counts double)."""
        if len(self.ids) > self.LIMIT:
            self._reset()
        found = [self.look(words_of(t)) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        out: list[list] = [[] for _ in texts]
        full = np.flatnonzero(sizes)
        for i in np.flatnonzero(sizes == 0):
            out[i].append((0, len(texts[i]), "und", 0.0, 0))
        if not len(full):
            return out
        scores = self.rows[np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))].astype(np.float64)
        ends = np.cumsum(sizes[full])
        starts = ends - sizes[full]
        sums = np.add.reduceat(scores, starts)
        main = sums.argmax(1)
        group = np.repeat(np.arange(len(full)), sizes[full])
        # the most that any stretch gains by leaving the main language; Viterbi keeps it throughout where no stretch gains the price
        gain = np.cumsum(scores - scores[np.arange(len(scores)), main[group]][:, None], axis=0)
        low = np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]])
        shift = low[starts][group]
        gain, low = gain - shift, low - shift
        # running minima restart at each text: texts are moved apart by a falling offset
        apart = (np.abs(gain).max() + 1) * 2 * group[:, None]
        rise = gain - (np.minimum.accumulate(low - apart, axis=0) + apart)
        most = np.maximum.reduceat(rise, starts)
        for k, i in enumerate(full):
            rivals = np.flatnonzero(most[k] > SWITCH)
            a, b = starts[k], ends[k]
            if not len(rivals):
                c = int(main[k])
                out[i].append((0, len(texts[i]), LANGUAGES[c], _confidence(sums[k], c, sizes[i]), len(texts[i])))
            else:
                use = [int(main[k]), *map(int, rivals[rivals != main[k]])]
                out[i] = _viterbi(texts[i], scores[a:b], use)
        return out


def _confidence(sums: np.ndarray, c: int, n: int) -> float:
    """Probability of ``c`` against the best other language, evidence being tempered for length."""
    rest = np.delete(sums, c).max()
    return round(1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, (sums[c] - rest) / max(1.0, n**0.5))))), 4)


def _path(scores: np.ndarray) -> list[int]:
    """The column that the best path takes in each row, changes costing :data:`SWITCH`; of equals the earlier column."""
    n, k = scores.shape
    path = [0] * n
    if k == 2:  # nearly always; then only the lead of the second column counts, and a change pays once it exceeds the price
        lead, back = 0.0, [0] * n
        for i, x in enumerate((scores[:, 1] - scores[:, 0]).tolist()):
            if lead > SWITCH:
                lead, back[i] = SWITCH, 1
            elif lead < -SWITCH:
                lead, back[i] = -SWITCH, -1
            lead += x
        j = int(lead > 0)
        for i in range(n - 1, -1, -1):
            path[i] = j
            j = j if not back[i] else int(back[i] > 0)
        return path
    best = [0.0] * k
    came_from: list[list[int]] = []
    columns = range(k)
    for row in scores.tolist():
        top = max(columns, key=best.__getitem__)
        limit = best[top] - SWITCH
        came = [j if best[j] >= limit else top for j in columns]
        best = [best[came[j]] - (SWITCH if came[j] != j else 0.0) + row[j] for j in columns]
        came_from.append(came)
    j = max(columns, key=best.__getitem__)
    for i in range(n - 1, -1, -1):
        path[i] = j
        j = came_from[i][j]
    return path


def _viterbi(text: str, scores: np.ndarray, use: list[int]) -> list[tuple[int, int, str, float, int]]:
    """The best labelling of words by the languages ``use``, changes costing :data:`SWITCH`, as segments of ``text``."""
    path = _path(scores[:, use])
    places = [(m.start(), m.end()) for m in _WORD.finditer(prose(text))]
    out: list[tuple[int, int, str, float, int]] = []
    i, n = 0, len(path)
    places = places if len(places) == n else [(len(text) * k // n, len(text) * (k + 1) // n) for k in range(n)]
    while i < n:
        k = i
        while k < n and path[k] == path[i]:
            k += 1
        start = 0 if i == 0 else places[i][0]
        end = len(text) if k == n else places[k][0]
        c = use[path[i]]
        out.append((start, end, LANGUAGES[c], _confidence(scores[i:k].sum(0), c, k - i), end - start))
        i = k
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("claimed", pa.list_(pa.string())), ("segment", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("lang_code", pa.string()), ("confidence", pa.float64()), ("chars", pa.int64())])
_DDL = "doc_id long, claimed array<string>, segment int, start int, end int, lang_code string, confidence double, chars long"


def _kernel(model: Model, repair: bool, pack: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(model)
        for batch in batches:
            ids, texts, claimed = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            read = [rough_repair(t) for t in texts] if repair else texts
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to]) <= pack):
                    size += len(texts[to])
                    to += 1
                rows = [(ids[at + i], claimed[at + i], k, *s) for i, segments in enumerate(labeller.label(read[at:to])) for k, s in enumerate(segments)]
                at = to
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return run


def label_segments(documents: DataFrame, model: Model | None = None, repair: bool = False) -> DataFrame:
    """Segments of one language each, covering every document: ``doc_id``, ``claimed``, ``segment``, ``start``, ``end``, ``lang_code``, ``confidence``, ``chars``.

    Script decides between Chinese, Russian and the rest; words score the other languages; Viterbi with
    a price on every change places the changes. ``claimed`` is what the label names. Texts without a word (NULL and empty too) have one segment ``und`` of
    confidence 0. With ``repair`` wrongly decoded texts are restored before labelling, and offsets are those of the
    restored text. Rows are handled one by one, without a shuffle; the model is bounded (:func:`fit`).
    """
    model = model or fit(documents)
    return documents.select("doc_id", "text", named(F.col("lang")).alias("claimed")).mapInArrow(_kernel(model, repair), _DDL)


def shares(segments: DataFrame) -> DataFrame:
    """Characters and mean confidence of each language of a document, and its ``share`` of the characters."""
    by = segments.groupBy("doc_id", "lang_code").agg(
        F.sum("chars").alias("chars"), F.max("claimed").alias("claimed"),
        (F.sum(F.col("confidence") * F.col("chars")) / F.greatest(F.sum("chars"), F.lit(1))).alias("confidence"),
    )
    total = by.groupBy("doc_id").agg(F.sum("chars").alias("_all"), F.collect_set(F.struct("lang_code", "chars", "confidence", "claimed")).alias("_by"))
    return total.select("doc_id", "_all", F.explode("_by").alias("b")).select("doc_id", "b.lang_code", "b.chars", "b.claimed", "b.confidence", F.when(F.col("_all") > 0, F.col("b.chars") / F.col("_all")).otherwise(F.lit(0.0)).alias("share"))


_CASE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("by", pa.list_(pa.struct([("lang_code", pa.string()), ("confidence", pa.float64()), ("share", pa.float64())])))])


def _cases(model: Model, least_share: float):
    """Documents whose languages are not those that the label names, with their text for a last look at its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(model)
        for batch in batches:
            ids, texts, claimed = (c.to_pylist() for c in batch.columns)
            for i in range(0, len(ids), 400):
                rows = []
                for doc, text, names, segments in zip(ids[i:], texts[i:], claimed[i:], labeller.label([rough_repair(t) for t in texts[i : i + 400]])):
                    size: Counter = Counter()
                    sure: Counter = Counter()
                    for _, _, code, confidence, n in segments:
                        size[code] += n
                        sure[code] += confidence * n
                    whole = sum(size.values())
                    found = [c for c, n in size.items() if c != "und" and n >= least_share * whole]
                    if found and set(found) != set(names):
                        rows.append((doc, text, [{"lang_code": c, "confidence": sure[c] / size[c], "share": size[c] / whole} for c in found]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CASE)], schema=_CASE)

    return run


def mislabelled(documents: DataFrame, model: Model | None = None, least_share: float = 0.2, least_chars: int = 60) -> DataFrame:
    """Documents whose label is missing, wrong or does not name all languages: ``doc_id``, ``lang_code``, ``confidence``, ``share``.

    One row for each language with ``least_share`` of the characters. Texts under ``least_chars``, program code and
    unreadable texts are left out; the kind of text is asked only for documents that would be cases. Wrongly decoded
    text is restored before it is labelled. Documents are decided one by one, without a shuffle; one stored twice comes out twice.
    """
    model = model or fit(documents)
    used = documents.filter(F.length("text") >= least_chars).select("doc_id", "text", named(F.col("lang")).alias("claimed"))
    cases = used.mapInArrow(_cases(model, least_share), "doc_id long, text string, by array<struct<lang_code: string, confidence: double, share: double>>")
    readable = with_kind(cases, "text", ("code", "junk")).filter("text_kind NOT IN ('code', 'junk')")
    return readable.select("doc_id", F.inline("by"))


def codes(labels: Iterable[str | None]) -> list[str | None]:
    """Plain form of :func:`named` for single labels, as used by tests."""
    return [_CODES.get(re.split(r"[-_.]", (x or "").strip().lower())[0]) for x in labels]
