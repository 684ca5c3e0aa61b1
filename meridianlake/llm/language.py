"""Language of each stretch of text, by error-correcting output codes over character n-grams.

The languages are those that the labels name. Every language is a codeword of an exhaustive code (a random one for more than
EXHAUSTIVE languages). One binary classifier per bit (naive Bayes over character n-grams of
words) tells the languages with a 1 from those with a 0. A sentence gets the codeword of the least weighted logistic
loss; sentences whose two best codewords are close are flagged ambiguous and lean on their neighbours.

The classifiers are fitted on a bounded sample of labelled rows (`sample_rows`); wrong labels in the sample are dropped
after a first fit. Everything else runs over all rows, map-only, without a shuffle of texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, parse_json, sentence_spans

#: Languages that are assumed where the labels name fewer than two.
LANGUAGES = ("en", "it", "de", "fr", "es")
#: Labelled rows of the sample that a language needs, and languages up to which the code is exhaustive.
LEAST_ROWS, EXHAUSTIVE = 5, 7
#: Share of a label's texts that must read as its own for it to name a language: wrong labels may outnumber the right ones of a
#: rare language, a label that names none has next to none of its own.
OWN_SHARE = 0.15
#: Weight of all bits together, for any number of them, so that costs and thresholds mean the same for any number of languages.
WEIGHT = 7.5

# Names and three-letter codes of the languages.
NAMES = {
    "en": ("eng", "english", "englisch", "inglese", "anglais", "inglés"),
    "it": ("ita", "italian", "italiano", "italienisch", "italien"),
    "de": ("deu", "ger", "german", "deutsch", "tedesco", "allemand", "alemán"),
    "fr": ("fra", "fre", "french", "français", "francais", "französisch", "francese", "francés"),
    "es": ("spa", "spanish", "español", "espanol", "spanisch", "spagnolo", "espagnol"),
}
BY_NAME = {name: code for code, names in NAMES.items() for name in (code, *names)}
LETTERS = re.compile(r"[^\W\d_]+")
WHOLE = re.compile(r"[.!?…][\"'»”’)\]]*\s*$")


def running_words(text: str) -> list[str]:
    """Lower-case words of text; none where most of its tokens are codes, numbers or separators."""
    tokens = text.lower().split()
    plain = [t for t in tokens if t.isalpha() or not any(map(str.isdigit, t)) and any(map(str.isalpha, t))]
    return LETTERS.findall(" ".join(plain)) if len(plain) >= 0.6 * len(tokens) else []


def label_of(metadata: str | None) -> str | None:
    """Language code named by the label under language, lang or doc.language; None if there is none that names a language."""
    obj = parse_json(metadata)
    if obj is None:
        return None
    doc = obj.get("doc")
    for value in (obj.get("language"), obj.get("lang"), doc.get("language") if isinstance(doc, dict) else None, obj.get("doc.language")):
        if isinstance(value, str) and value.strip():
            name = value.strip().lower()
            code = re.split(r"[-_\s(]", name)[0]
            # Other two-letter codes may name a language too: the texts tell.
            return BY_NAME.get(name) or BY_NAME.get(code) or (code if re.fullmatch(r"[a-z]{2}", code) else None)
    return None


def codewords(n: int) -> np.ndarray:
    """The code of n classes, +1 and -1: one column for each split into two, or, for many classes, the best of some random codes."""
    if n > EXHAUSTIVE:
        rng, bits = np.random.default_rng(n), 10 * int(np.ceil(np.log2(n)))
        drawn = [np.where(rng.random((n, bits)) < 0.5, 1, -1) for _ in range(50)]
        apart = lambda c: min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        split = [c[:, np.abs(c.sum(0)) < n] for c in drawn]  # a bit without two sides tells nothing
        return max(split, key=apart).astype(np.float32)
    rest = range(1, n)
    ones = [(0, *more) for size in range(n - 1) for more in combinations(rest, size)]
    code = -np.ones((n, len(ones)), dtype=np.float32)
    for bit, members in enumerate(ones):
        code[list(members), bit] = 1
    return code


def ngrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)] + [padded]


class Model:
    """n-gram weights for each bit, and the weight of each bit by how well it separates the sample."""

    def __init__(self, languages: tuple[str, ...], grams: dict[str, int], weights: np.ndarray, code: np.ndarray, bits: np.ndarray, temperature: float):
        self.languages, self.grams, self.weights, self.code, self.bits, self.temperature = languages, grams, weights, code, bits, temperature
        self.words: dict[str, int] = {}
        self.table = np.zeros((1024, code.shape[1]), dtype=np.float32)

    def __getstate__(self):
        return (self.languages, self.grams, self.weights, self.code, self.bits, self.temperature)

    def __setstate__(self, state):
        self.__init__(*state)

    def index(self, words: list[str]) -> np.ndarray:
        """Row of each word in the table of word scores; a word's score is the mean weight of its n-grams times its root length."""
        known = self.words
        if len(known) > 1_000_000:
            known.clear()
        for word in set(words).difference(known):
            rows = [self.grams[g] for g in ngrams(word) if g in self.grams]
            at = len(known)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self.weights[rows].sum(0) / (2 + len(word)) ** 0.5 if rows else 0
            known[word] = at
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def losses(self, counts: list[int], words: list[str]) -> np.ndarray:
        """Loss of every language for each sentence, given as the number of its words in the flat list of words."""
        sums = np.zeros((len(counts), self.code.shape[1]), dtype=np.float32)
        if words:
            n = np.asarray(counts)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            sums[n > 0] = np.add.reduceat(self.table_rows(words), starts[n > 0], axis=0)
        margin = sums / self.temperature
        agree = margin[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0, -agree) * self.bits).sum(2)

    def table_rows(self, words: list[str]) -> np.ndarray:
        rows = self.index(words)
        return self.table[rows]


def fit(texts: list[str], labels: list[str], temperature: float = 6.0, rounds: int = 2) -> Model:
    """Bit classifiers from labelled texts, for the languages that are labelled LEAST_ROWS times.

    A label hardly any of whose texts are decoded as its own names no language and leaves first; then, after each round, texts whose
    decoded language differs from the label.
    """
    named = Counter(labels)
    languages = sorted((k for k, n in named.items() if n >= LEAST_ROWS), key=lambda k: (-named[k], k))
    words = [running_words(t) for t in texts]
    while len(languages) > 2:
        model = _fit(words, labels, tuple(languages), temperature, 0)
        best = _decoded(model, words)
        right = Counter(x for x, y in zip(labels, best) if x == y)
        wrong = [k for k in languages if right[k] < OWN_SHARE * named[k]]
        if not wrong:
            break
        languages.remove(min(wrong, key=lambda k: (right[k] / named[k], k)))
    if len(languages) < 2:
        languages += [k for k in LANGUAGES if k not in languages]
    return _fit(words, labels, tuple(languages), temperature, rounds)


def _decoded(model: Model, words: list[list[str]]) -> list[str]:
    best = model.losses([len(w) for w in words], [w for ws in words for w in ws]).argmin(1)
    return [model.languages[k] for k in best]


def _fit(words: list[list[str]], labels: list[str], languages: tuple[str, ...], temperature: float, rounds: int) -> Model:
    code = codewords(len(languages))
    keep = [i for i, label in enumerate(labels) if label in languages]
    for step in range(rounds + 1):
        # In the first round half of the code's mass comes from wrong labels at most; smoothing keeps their n-grams weak.
        by_lang: dict[str, Counter] = defaultdict(Counter)
        for i in keep:
            by_lang[labels[i]].update(words[i])
        grams: dict[str, int] = {}
        counts: list[np.ndarray] = []
        for k, lang in enumerate(languages):
            for word, n in by_lang[lang].items():
                for g in ngrams(word):
                    at = grams.setdefault(g, len(grams))
                    if at == len(counts):
                        counts.append(np.zeros(len(languages), dtype=np.float32))
                    counts[at][k] += n
        table = np.stack(counts) if counts else np.zeros((0, len(languages)), dtype=np.float32)
        rate = (table + 0.5) / (table.sum(0, keepdims=True) + 0.5 * max(1, len(grams)))
        weights = np.zeros((len(grams), code.shape[1]), dtype=np.float32)
        for bit in range(code.shape[1]):
            weights[:, bit] = np.log(rate[:, code[:, bit] > 0].mean(1) / rate[:, code[:, bit] < 0].mean(1))
        model = Model(languages, grams, np.clip(weights, -4, 4), code, np.full(code.shape[1], WEIGHT / max(1, code.shape[1]), dtype=np.float32), temperature)
        if not words:
            return model
        good = [i for i, lang in enumerate(_decoded(model, words)) if lang == labels[i]]
        if step == rounds:
            # A bit counts by the share of the sample that it tells apart rightly.
            sums = np.zeros((len(good), code.shape[1]), dtype=np.float32)
            for row, i in enumerate(good):
                if words[i]:
                    sums[row] = model.table_rows(words[i]).sum(0)
            truth = np.stack([code[languages.index(labels[i])] for i in good]) if good else np.zeros((0, code.shape[1]))
            right = ((sums * truth) > 0).mean(0) if good else np.ones(code.shape[1])
            model.bits = (np.maximum(right, 0.5) / np.maximum(right, 0.5).sum()).astype(np.float32) * WEIGHT
            return model
        keep = good or keep
    return model


def smooth(loss: np.ndarray, switch: float) -> np.ndarray:
    """Languages of the least total loss over the sentences of one text, each change of language costing `switch`."""
    n, k = loss.shape
    cost, back = loss[0].copy(), np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        best = cost.argmin()
        jump = cost[best] + switch
        back[i] = np.where(cost <= jump, np.arange(k), best)
        cost = np.minimum(cost, jump) + loss[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = cost.argmin()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def segment(model: Model, texts: list[str | None], switch: float = 6.0, least_gain: float = 3.0, sure: float = 8.0):
    """For each text its stretches (language, confidence, ambiguous, start, end). Texts without readable sentences have none."""
    spans_of, counts, words, short = [], [], [], []
    for text in texts:
        spans = sentence_spans(text) if text else []
        spans_of.append(spans)
        for a, b in spans:
            found = running_words(text[a:b])
            short.append(len(found) < 4 or len(found) < 7 and not WHOLE.search(text, a, b))
            counts.append(len(found))
            words.extend(found)
    loss = model.losses(counts, words)
    flat = model.losses([0], [])[0][0] if counts else 0.0
    order = np.sort(loss, axis=1) if len(loss) else loss
    gap = order[:, 1] - order[:, 0] if len(loss) else np.zeros(0)
    best = loss.argmin(1) if len(loss) else np.zeros(0, dtype=np.int64)
    gain = flat - order[:, 0] if len(loss) else np.zeros(0)
    size, brief = np.asarray(counts), np.asarray(short, dtype=bool)
    out, at = [], 0
    for spans in spans_of:
        n = len(spans)
        rows = slice(at, at + n)
        at += n
        # A readable text has a sentence of at least three words whose codeword explains it better than none.
        if not n or not ((gain[rows] >= least_gain) & (size[rows] >= 3)).any():
            out.append([])
            continue
        langs = best[rows]
        if (langs != langs[0]).any():
            langs = smooth(np.where(brief[rows][:, None], loss[rows] * 0.3, loss[rows]), switch)
        stretches, start = [], 0
        for i in range(1, n + 1):
            if i == n or langs[i] != langs[start]:
                total = loss[rows][start:i].sum(0)
                p = np.exp(-(total - total.min()))
                conf = float(p[langs[start]] / p.sum())
                near = float(np.sort(total)[1] - total.min())
                stretches.append((model.languages[langs[start]], conf, bool(near < sure), spans[start][0], spans[i - 1][1]))
                start = i
        out.append(stretches)
    return out


SEGMENTS = "id string, version long, seg long, lang string, confidence double, ambiguous boolean, start long, stop long, label string, is_case boolean"


def detect_languages(chunks: DataFrame, sample_rows: int = 3000) -> DataFrame:
    """One row per stretch of one language in each chunk, in reading order.

    `is_case` marks chunks whose label is missing, unreadable, names no language, or isn't the one language of the content.
    Null, empty, blank and code-only contents have no stretch. An id delivered twice counts once, with one of its contents if
    they differ. Ties between codewords go to the language with more labels. Other columns are ignored. Without labelled rows
    nothing can be fitted and no stretch comes out with a confidence above chance; an empty table gives an empty result.
    """
    rows = chunks.select(F.col("id").cast("string").alias("id"), F.col("metadata").cast("string").alias("metadata"), F.col("content").cast("string").alias("content")).withColumn("version", F.xxhash64("metadata", "content"))
    named = F.lower(F.trim(F.coalesce(F.try_variant_get(v := F.try_parse_json("metadata"), "$.language", "string"), F.try_variant_get(v, "$.lang", "string"), F.try_variant_get(v, "$.doc.language", "string"))))
    labelled = rows.where(F.col("content").isNotNull() & F.col("metadata").rlike('"(language|lang)"') & named.isNotNull())
    sample = bounded_sample(labelled, "id", sample_rows, labelled.count()).select("metadata", "content").toPandas()
    labels = sample["metadata"].map(label_of)
    good = labels.notna()
    model = fit(sample["content"][good].tolist(), labels[good].tolist())
    shared = chunks.sparkSession.sparkContext.broadcast(model)  # bounded by sample_rows

    def run(frames):
        held = shared.value
        for pdf in frames:
            got = []
            for key, version, metadata, stretches in zip(pdf["id"], pdf["version"], pdf["metadata"], segment(held, [c if isinstance(c, str) else None for c in pdf["content"]])):
                if stretches:
                    label = label_of(metadata)
                    label = label if label in held.languages else None
                    case = len(stretches) > 1 or label != stretches[0][0]
                    got += [(key, version, k + 1, lang, conf, amb, a, b, label, case) for k, (lang, conf, amb, a, b) in enumerate(stretches)]
            yield pd.DataFrame(got, columns=["id", "version", "seg", "lang", "confidence", "ambiguous", "start", "stop", "label", "is_case"])

    found = rows.mapInPandas(run, SEGMENTS)
    one = found.withColumn("first", F.min("version").over(Window.partitionBy("id"))).where("version = first")
    return one.dropDuplicates(["id", "seg"]).drop("version", "first")
