"""Languages of texts and of their stretches, by string kernels.

The kernel of two strings is the blended spectrum presence kernel: the number of n-grams of 1 to 3 characters that
both hold, normalised. A Nyström approximation over landmark strings and one-versus-rest kernel ridge regression give
a weight for each landmark and language. Scores of a batch are its presence matrix times the landmarks' presence
matrix times these weights; the last two are multiplied once, so that a batch takes one product over the n-grams it
holds. Texts are cut at sentences, the path of least cost through the sentences' scores gives the stretches.

Texts of any length are scored by the kernel, a text without a sentence as a whole. A score is about 1 for the text's language
and -1 for others; where the best is not above REFUSE_SCORE and less than REFUSE_MARGIN above the next, no language is named: a text
of codes and numbers, or in a language that wasn't learned, comes out as ``und``. The confidence is the softmax of the scores
at a temperature that fits sentences held out of the fit, so it falls with short and doubtful texts.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE_DOCS a language, SENTENCES of each); labels may be wrong in part:
the fit is repeated without the sentences that it contradicts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.llm.topn import top_n_per_group
from dapple.runtime import spread

#: Codes and names of the languages (ISO 639-1, 639-2, 639-3, English and own names).
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castilian"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "pl": ("pl", "pol", "polish", "polski"),
    "ru": ("ru", "rus", "russian", "русский"),
}
CODES = tuple(NAMES)
UNDETERMINED = "und"
SAMPLE_DOCS = 300
SENTENCES = 3
LANDMARKS_EACH = 80
NGRAMS = (1, 2, 3)
HASH_BITS = 20
RIDGE = 1e-3
MIN_WORDS = 4  # shorter units are tags, labels or single words: no evidence of their own
WINDOW_WORDS = 12
SWITCH = 0.6
REFUSE_SCORE, REFUSE_MARGIN = 0.1, 0.4
TEMPERATURES = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0)
BATCH_CHARS = 400_000

_MARKUP = re.compile(r"<[^<>]{1,300}>")
_TAG = re.compile(r"[\[(]\s*\w+\s*[:=/][^\[\]()]*[\])]|(?<!\w)[#@]\w+")
_PAIR = re.compile(r"\w+=\w+")
_BREAK = re.compile(r"[.!?…\r\n][.!?…\"»”’')\]\r\n\t ]*(?<=\s)|(?<=\s)(?:[|•·*/–—]|--+)\s")
_WORD = re.compile(r"\b[^\W\d_]{2,}\b")
_LETTERS = re.compile(r"\b[^\W\d_]+\b")  # a letter run in a code (4f2be1, a_b) is no word


def named_language(lang: Column) -> Column:
    """The code that a language label names, whatever its spelling or region; null if it names none of CODES."""
    base = F.split(F.lower(F.trim(lang)), r"[-_ ]")[0]
    expr = F.lit(None).cast("string")
    for code, names in NAMES.items():
        expr = F.when(base.isin(*names), F.lit(code)).otherwise(expr)
    return expr


def units(text: str) -> list[str]:
    """Sentences and lines of a text without mark-up and tags; longer runs without a break are cut into windows of words."""
    out = []
    if "<" in text:
        text = _MARKUP.sub("\n", text)
    if "#" in text or "[" in text or "(" in text or "@" in text:
        text = _TAG.sub(" ", text)
    if "=" in text:
        text = _PAIR.sub(" ", text)
    at = 0
    for end in [*(m.end() for m in _BREAK.finditer(text)), len(text)]:
        piece, at = text[at:end], end
        if len(piece) > 6 * WINDOW_WORDS and len(words := piece.split()) > 3 * WINDOW_WORDS:
            n = len(words) // WINDOW_WORDS
            out += [" ".join(words[len(words) * i // n : len(words) * (i + 1) // n]) for i in range(n)]
        elif piece and not piece.isspace():
            out.append(piece)
    return out


def word_count(unit: str) -> int:
    return len(_WORD.findall(unit))


def normal(unit: str) -> str:
    """The words in lower case between single spaces; empty without words."""
    words = _LETTERS.findall(unit.lower())
    return " " + " ".join(words) + " " if words else ""


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) pairs of the n-grams present in each text, sorted; n-grams as hashes of HASH_BITS bits."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    keys = []
    h = np.zeros(len(chars), np.uint64)
    for n in NGRAMS:
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(1_000_003) + chars[n - 1 :] + np.uint64(n)
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        whole = owner[:m] == owner[n - 1 :]
        keys.append((owner[:m][whole].astype(np.uint64) << np.uint64(HASH_BITS)) | (mixed[whole] >> np.uint64(64 - HASH_BITS)))
    pairs = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    return (pairs >> np.uint64(HASH_BITS)).astype(np.int64), (pairs & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def _kernel(rows: tuple, n: int, landmarks: tuple, m: int) -> np.ndarray:
    """The normalised presence kernel of n texts with m landmarks."""
    used, inverse = np.unique(landmarks[1], return_inverse=True)
    dense = np.zeros((len(used), m), np.float32)
    dense[inverse, landmarks[0]] = 1
    at = np.searchsorted(used, rows[1])
    at[at == len(used)] = 0
    hit = used[at] == rows[1]
    owner, at = rows[0][hit], at[hit]
    out = np.zeros((n, m), np.float64)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    for a, b in zip(starts, np.r_[starts[1:], len(owner)], strict=True):
        out[owner[a]] = dense[at[a:b]].sum(axis=0)
    size = lambda p, k: np.sqrt(np.maximum(np.bincount(p[0], minlength=k), 1))
    return out / size(rows, n)[:, None] / size(landmarks, m)[None, :]


@dataclass
class LanguageModel:
    codes: tuple[str, ...]
    grams: np.ndarray  # sorted n-gram hashes of the landmarks
    weights: np.ndarray  # n-gram x language: landmarks' presence times their weights
    temperature: float = 3.0  # of the confidence

    def __post_init__(self):
        self.row = np.full(1 << HASH_BITS, -1, np.int32)  # by n-gram hash
        self.row[self.grams] = np.arange(len(self.grams))

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], rounds: int = 2, landmarks_each: int = LANDMARKS_EACH) -> LanguageModel:
        """Fit on sentences with labels, some of which may be wrong. Each language needs a sentence.

        The first round takes every other sentence of a language; the ones left out tell the temperature, and all that
        it contradicts are left out of the next."""
        codes = tuple(sorted(set(labels)))
        if not codes:
            raise ValueError("no labelled sentences to fit on")
        all_texts, y = [normal(t) for t in texts], np.array([codes.index(x) for x in labels])
        pairs = presence(all_texts)
        order = np.empty(len(y), np.int64)  # number of a sentence within its language
        for c in range(len(codes)):
            order[y == c] = np.arange((y == c).sum())
        keep = order % 2 == 0
        model, temperature = None, 3.0
        for no in range(rounds):
            chosen = np.concatenate([np.flatnonzero(keep & (y == c))[:landmarks_each] for c in range(len(codes))])
            marks = presence([all_texts[i] for i in chosen])
            k = _kernel(pairs, len(y), marks, len(chosen))
            kmm = k[chosen]
            target = np.where(y[keep][:, None] == np.arange(len(codes))[None, :], 1.0, -1.0)
            knm = k[keep]
            left = knm.T @ knm + RIDGE * len(knm) * kmm + 1e-8 * np.eye(len(chosen))
            alpha = np.linalg.solve(left, knm.T @ target)
            scores = k @ alpha
            keep_next = scores.argmax(axis=1) == y
            if no == 0:
                temperature = _temperature(scores[~keep], y[~keep])
            used, inverse = np.unique(marks[1], return_inverse=True)
            size = np.sqrt(np.maximum(np.bincount(marks[0], minlength=len(chosen)), 1))
            weights = np.zeros((len(used), len(codes)))
            np.add.at(weights, inverse, (alpha / size[:, None])[marks[0]])
            model = cls(codes, used, weights.astype(np.float32), temperature)
            if all((keep_next & (y == c)).any() for c in range(len(codes))):
                keep = keep_next
        return model

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of each text (rows) for each language, about 1 for its language and -1 for others."""
        out = np.zeros((len(texts), len(self.codes)))
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            owner, gram = presence([normal(t) for t in texts[at:end]])
            size = np.bincount(owner, minlength=end - at)
            pos = self.row[gram]
            hit = pos >= 0
            owner, pos = owner[hit], pos[hit]
            if len(owner):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out[at + owner[starts]] = np.add.reduceat(self.weights[pos], starts, axis=0) / np.sqrt(np.maximum(size[owner[starts]], 1))[:, None]
            at = end
        return out


def softmax(scores: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(temperature * (scores - scores.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature at which labels are likeliest, without the labels that are clearly wrong."""
    if not len(y):
        return 3.0
    own = scores[np.arange(len(y)), y]
    sure = ~((own < -0.3) & (scores.max(axis=1) > 0.3))
    if not sure.any():
        return 3.0
    loss = [-np.log(np.maximum(softmax(scores[sure], t)[np.arange(sure.sum()), y[sure]], 1e-12)).mean() for t in TEMPERATURES]
    return TEMPERATURES[int(np.argmin(loss))]


def refused(scores: np.ndarray) -> np.ndarray:
    """Whether no language is to be named by scores (rows)."""
    top = np.sort(scores, axis=1)
    margin = top[:, -1] - (top[:, -2] if scores.shape[1] > 1 else -1.0)
    return (top[:, -1] <= REFUSE_SCORE) & (margin < REFUSE_MARGIN)


def _path(scores: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The language of each unit on the best path; each change costs SWITCH."""
    gain = scores * weight[:, None]
    total, back = gain[0].copy(), np.zeros(scores.shape, np.int64)
    for i in range(1, len(scores)):
        best = int(total.argmax())
        change = total[best] - SWITCH > total
        back[i] = np.where(change, best, np.arange(len(total)))
        total = np.where(change, total[best] - SWITCH, total) + gain[i]
    path = np.empty(len(scores), np.int64)
    path[-1] = int(total.argmax())
    for i in range(len(scores) - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def stretches(texts: list[str], model: LanguageModel) -> Iterator[tuple[int, int, str, float, int]]:
    """(text, seg_no, lang, confidence, units) of each stretch of each text; blank texts give none.

    A stretch whose language can't be told joins the one before it, or the one behind; a text of only such is ``und``."""
    parts = [units(t) for t in texts]
    counts = [[word_count(u) for u in p] for p in parts]
    weight: list[np.ndarray] = []
    flat: list[str] = []
    for i, (p, c) in enumerate(zip(parts, counts, strict=True)):
        if max(c, default=0) < MIN_WORDS:  # no sentence: the text as a whole
            p = parts[i] = [" ".join(p)] if texts[i].strip() else []
            c = [MIN_WORDS] * len(p)
        weight.append(np.array([1.0 if x >= MIN_WORDS else 0.0 for x in c]))
        flat += p
    scores, at = model.scores(flat), 0
    top = scores.argmax(axis=1)

    def summed(a: int, b: int, w: np.ndarray) -> np.ndarray:
        w = np.maximum(w, 1e-3)
        return w @ scores[a:b] / w.sum()

    segments: list[tuple[int, int, int, int]] = []  # text, seg_no, language, units
    means: list[np.ndarray] = []
    for i, p in enumerate(parts):
        n, w = len(p), weight[i]
        if not n:
            continue
        told = top[at : at + n][w > 0]
        if not len(told) or (told == told[0]).all():
            lang = int(told[0]) if len(told) else int(scores[at : at + n].sum(axis=0).argmax())
            segments.append((i, 1, lang, n))
            means.append(summed(at, at + n, w))
        else:
            path = _path(scores[at : at + n], w)
            starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            for no, (a, b) in enumerate(zip(starts, np.r_[starts[1:], n], strict=True), 1):
                segments.append((i, no, int(path[a]), int(b - a)))
                means.append(summed(at + a, at + b, w[a:b]))
        at += n
    if not segments:
        return
    mean = np.stack(means)
    share, no_one = softmax(mean, model.temperature), refused(mean)
    at = 0
    while at < len(segments):
        end = at + 1
        while end < len(segments) and segments[end][0] == segments[at][0]:
            end += 1
        i = segments[at][0]
        told = [j for j in range(at, end) if not no_one[j]]
        if not told:
            yield i, 1, UNDETERMINED, float(1 - share[at:end].max()), sum(segments[j][3] for j in range(at, end))
        elif len(told) == end - at:
            for j in told:
                _, no, lang, n = segments[j]
                yield i, no, model.codes[lang], float(share[j, lang]), n
        else:
            merged: list[list] = []  # language, least confidence, units
            waiting = 0
            for j in range(at, end):
                _, _, lang, n = segments[j]
                if no_one[j]:
                    if merged:
                        merged[-1][2] += n
                    else:
                        waiting += n
                elif merged and merged[-1][0] == lang:
                    merged[-1][1], merged[-1][2] = min(merged[-1][1], share[j, lang]), merged[-1][2] + n
                else:
                    merged.append([lang, share[j, lang], n + waiting])
                    waiting = 0
            for no, (lang, conf, n) in enumerate(merged, 1):
                yield i, no, model.codes[lang], float(conf), n
        at = end


def fit_language_model(df: DataFrame, doc_id: str, text: str, lang: str, sample_docs: int = SAMPLE_DOCS, sentences: int = SENTENCES) -> LanguageModel:
    """Fit on at most ``sample_docs`` labelled documents a language, chosen by a hash of the identifier, and at most
    ``sentences`` sentences of each. Null and unknown labels take no part."""
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), named_language(F.col(lang)).alias("lang")).where("lang IS NOT NULL AND trim(text) != ''")
    rows = rows.withColumn("h", F.xxhash64("id")).select("lang", "h", "id", "text")
    sample = top_n_per_group(rows.select("lang", "h", "id"), ["lang"], [F.col("h").asc(), F.col("id").asc()], ["h", "id"], sample_docs)
    texts, labels = [], []
    for row in rows.join(F.broadcast(sample.select("id", F.col("lang").alias("_l"))), "id", "left_semi").toLocalIterator():
        good = [u for u in units(row.text) if word_count(u) >= MIN_WORDS + 1]
        step = max(1, len(good) // sentences)
        for u in good[::step][:sentences]:
            texts.append(u)
            labels.append(row.lang)
    return LanguageModel.fit(texts, labels)


def document_languages(df: DataFrame, model: LanguageModel, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``seg_no`` (from 1), ``lang``, ``confidence``, ``sentences``, ``segments``: each stretch of each text in one language.

    Neighbouring stretches differ. A text without words, or in no language that was learned, is one stretch of ``und``,
    whose confidence is what is left of the likeliest language's; null and blank texts give no rows.
    Single words, tags and labels belong to the stretch around them. Repeated rows give repeated results.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (chars == 0 or chars < 4 * BATCH_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                rows = list(stretches([t or "" for t in texts[at:end]], shared.value))
                if rows:
                    doc, no, lang, conf, n = zip(*rows, strict=True)
                    total = np.bincount(np.array(doc), minlength=end - at)
                    yield pa.RecordBatch.from_pydict({
                        doc_id: ids.take(pa.array(np.array(doc) + at)), "seg_no": pa.array(no, pa.int32()), "lang": pa.array(lang),
                        "confidence": pa.array(conf, pa.float64()), "sentences": pa.array(n, pa.int32()), "segments": pa.array(total[np.array(doc)], pa.int32()),
                    })
                at = end

    rows = spread(df.select(F.col(doc_id).cast("bigint"), F.col(text)).where(F.trim(F.col(text)) != ""))
    return rows.mapInArrow(run, f"{doc_id} bigint, seg_no int, lang string, confidence double, sentences int, segments int")


def label_errors(df: DataFrame, found: DataFrame, doc_id: str, lang: str) -> DataFrame:
    """The stretches of documents whose label is missing, names no language or another than the text, or whose text
    mixes languages. A label that names the right language in any spelling is right, as is ``und`` for ``und``."""
    base = F.lower(F.trim(F.col(lang)))
    labels = df.select(F.col(doc_id).alias("_id"), F.coalesce(named_language(F.col(lang)), F.when(base == UNDETERMINED, F.lit(UNDETERMINED))).alias("_named"))
    joined = found.join(labels, F.col(doc_id) == F.col("_id"))
    return joined.where((F.col("segments") > 1) | ~F.col("_named").eqNullSafe(F.col("lang"))).drop("_id", "_named")
