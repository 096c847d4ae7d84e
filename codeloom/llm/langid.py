"""Languages of documents and of the stretches in them.

A text's language is read from the average of hashed subword embeddings (words
and character n-grams) through a linear softmax, trained by stochastic gradient
descent in numpy on a bounded sample of labelled documents. Confidences are
calibrated by a temperature on sentences that training didn't see, and what
stays below a threshold or looks like no training text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.sources import spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "ru", "ja")
# ISO codes of three letters and names of the languages.
SPELLINGS = {
    "en": "en eng english anglais inglés inglese inglês englisch",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão",
    "fr": "fr fra fre french français francais französisch francés francese francês",
    "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo espanhol",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese",
    "it": "it ita italian italiano italienisch italien",
    "ru": "ru rus russian русский russisch russe ruso russo",
    "ja": "ja jpn japanese 日本語 japanisch japonais japonés giapponese japonês",
}
_SPELLED = {w: k for k, v in SPELLINGS.items() for w in v.split()}

SAMPLE_DOCUMENTS = 60  # labelled documents of each language that training sees
LEAST_STEPS = 900  # of training, however small the sample
BUCKETS, DIM, NGRAMS = 1 << 16, 16, (1, 3)
LEAST_CONFIDENCE = 0.6
STEADY = 0.85  # held-out agreement with the labels, some of which are wrong, of a model that needs no second try


def normal_label(lang: Column) -> Column:
    """The language that a label means, or null: case, region, three letters and names aside."""
    word = F.regexp_extract(F.lower(F.trim(lang)), r"^([\p{L}]+)", 1)
    pairs = [F.lit(x) for kv in _SPELLED.items() for x in kv]
    return F.create_map(*pairs)[word]


# Segments.

_FENCE = re.compile(r"(?:^|\n)[ \t]*(```+|~~~+)[^\n]*\n[\s\S]*?(?:\n[ \t]*\1[^\n]*(?=\n|\Z)|\Z)")
_LINES = re.compile(r"\r\n|\n|\r|\u2028")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d:\d\d|(?:\[\s*)?(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b|at \S+\(|File \"|Traceback|[$>] \S+|\+\+\+ |--- |@@ )")
_CODE = re.compile(r"^(?: {4,}|\t)(?!\s*(?:[-*+•>]|\d+[.)])\s)|[;{}]\s*$|^\s*(?:import|from|const|let|var|def|class|return|function|public|private|use|namespace|export|if|for|while|try|catch|else|switch|case)\b.*[({;:=]|=>|^\s*(?://|#include|<\?php|\$\w+\s*=)|^\s*</?\w+[^>]*>\s*$|^\s*\|.*\|\s*$")
_CODE_HINT = re.compile(r"[;{}=<|$\t(:/#]| {4}")
_HEAD = re.compile(r"^\s*(?:#{1,6}\s|=+\s*$|-+\s*$)")
_BULLET = re.compile(r"^\s*(?:[-*+•>]\s+|\d+[.)]\s+)+")
_INLINE = re.compile(r"`[^`]*`|https?://\S+|www\.\S+|\S+@\S+\.\w+|!?\[([^\]]*)\]\([^)]*\)|<[^>]{1,80}>")
_INLINE_HINT = re.compile(r"[`@\[<]|http|www")
_IDENT = re.compile(
    r"(?<![A-Za-z0-9_$])(?:[A-Za-z$]*[a-z][A-Z][A-Za-z0-9_$]*|[A-Za-z0-9$]*_[A-Za-z0-9_$]*|[A-Za-z0-9_\-]+(?:(?:[/.:]|::|->)[A-Za-z0-9_\-]+)+|[A-Za-z]+[0-9][A-Za-z0-9]*)(?:\(\))?"
)
_END = re.compile(r"[.!?…]+[\"'»”)\]*_]*(?![\w/\\\-=(:,@.!?…])|[。！？]+[」』）]*")
_ESCAPES = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_HIDDEN = re.compile(r"[\x00-\x08\x0e-\x1f\x7f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_IDENT_HINT = re.compile(r"[a-z][A-Z]|_|[A-Za-z0-9][/.:>][A-Za-z0-9]|[A-Za-z][0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")


@dataclass(frozen=True)
class Segment:
    begin: int  # offset in code points of the line that it stands in
    text: str  # what is left to read without code, links, numbers and identifiers
    whole: bool  # whether it is a whole sentence


def segments(text: str | None) -> list[Segment]:
    """The sentences of a text, and pieces that aren't whole ones, without code, logs and markup."""
    if not text:
        return []
    text = _ESCAPES.sub(lambda m: " " * len(m[0]), text)
    text = _FENCE.sub(lambda m: "\n" + " " * (len(m[0]) - 2) + "\n" if len(m[0]) > 1 else m[0], text)
    out, at = [], 0
    for m in [*_LINES.finditer(text), None]:
        line, begin, at = text[at:m.start() if m else len(text)], at, m.end() if m else len(text)
        if not line or line.isspace() or _LOG.match(line) or _CODE_HINT.search(line) and _CODE.search(line):
            continue
        head = _HEAD.match(line) is not None
        body = line.lstrip("# ") if head else line
        bullet = _BULLET.match(body)
        if bullet:
            body = body[bullet.end():]
        if _INLINE_HINT.search(body):
            body = _INLINE.sub(lambda x: f" {x[1]} " if x[1] else " ", body)
        last = 0
        for end in [*_END.finditer(body), None]:
            p = body[last:end.end() if end else len(body)]
            last = end.end() if end else len(body)
            left = _HIDDEN.sub("", p) if not p.isprintable() else p
            left = _IDENT.sub(" ", left) if _IDENT_HINT.search(left) else left
            words = len(_WORD.findall(left))
            if not words:
                continue
            cjk = 0 if left.isascii() else len(_CJK.findall(left))
            whole = not head and end is not None and (cjk >= 6 or words >= 3)
            out.append(Segment(begin, " ".join(left.split()), whole))
    return out


# Features and model.


def _orders(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and owning texts, ascending, for each n-gram length and for words."""
    joined = "".join([f"\x02{t.lower()}\x03" for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(codes == 2, dtype=np.int32) - 1
    codes = np.where(codes <= 32, np.uint32(32), codes)
    gap = codes == 32
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(codes), np.uint32)
        for n in range(1, max(NGRAMS) + 1):
            k = len(codes) - n + 1
            if k <= 0:
                break
            rolling = rolling[:k] * np.uint32(0x9E3779B1) + (codes[n - 1:] + np.uint32(n)) * np.uint32(0x85EBCA77)
            if n in NGRAMS:
                ok = ~gap if n == 1 else owner[:k] == owner[n - 1:]
                h = rolling[ok]
                yield ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)) >> np.uint32(16), owner[:k][ok]
        # Words: the sum of a word's mixed characters, taken from running sums.
        mixed = (codes + np.uint32(7)) * np.uint32(0x9E3779B1)
        mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x165667B1)
        first = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        last = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(mixed, dtype=np.uint32)))
        h = sums[last] - sums[first] + codes[first] * np.uint32(31)
        yield ((h ^ (h >> np.uint32(14))) * np.uint32(0x27D4EB2F)) >> np.uint32(16), owner[first]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and n-grams of all texts, one after the other, and where each text's begin."""
    buckets, owners = zip(*_orders(texts))
    owner, gram = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return gram[order] % BUCKETS, np.searchsorted(owner[order], np.arange(len(texts)))


@dataclass
class Model:
    table: np.ndarray  # what each bucket adds to the logits, all languages
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # whether training met the bucket

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, and the share of each text's features that training met."""
        if not texts:
            return np.zeros((0, len(LANGUAGES))), np.zeros(0)
        logits = np.zeros((len(texts), len(LANGUAGES)), np.float32)
        counts, known = np.zeros(len(texts)), np.zeros(len(texts))
        for gram, owner in _orders(texts):
            if len(gram):
                begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                whose = owner[begin]
                gram = gram % BUCKETS
                logits[whose] += np.add.reduceat(self.table[gram], begin, axis=0)
                known[whose] += np.add.reduceat(self.seen[gram].astype(np.float32), begin)
                counts[whose] += np.diff(np.append(begin, len(gram)))
        full = np.maximum(counts, 1)
        logits, known = logits / full[:, None], known / full
        z = (logits + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True), known


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, rate: float = 3.0, seed: int = 7) -> Model:
    """Trains on the sentences whose labels stand up to a model that didn't see them.

    Of up to three models the best by held-out sentences counts: the learning
    rate is halved while training goes astray.
    """
    kept = _believed(texts, labels, epochs, rate, seed)
    texts, labels = [texts[i] for i in kept], labels[kept]
    best, score = None, -1.0
    for _ in range(3):
        model, right = _train(texts, labels, epochs, rate, seed)
        if best is None or right > score:
            best, score = model, right
        if right >= STEADY:
            break
        rate /= 2
    return best


def _believed(texts: list[str], labels: np.ndarray, epochs: int, rate: float, seed: int) -> np.ndarray:
    """Places of the sentences that a model of the other half doesn't firmly give another language.

    A label counts as wrong only where the other half knows its language well.
    """
    half = np.random.default_rng(seed).random(len(texts)) < 0.5
    keep = np.ones(len(texts), bool)
    for mine in (half, ~half):
        theirs = np.flatnonzero(~mine)
        own = np.flatnonzero(mine)
        if len(own) < 100 or not len(theirs):
            continue
        model, _ = _train([texts[i] for i in own], labels[own], epochs // 2, rate, seed, LEAST_STEPS // 2)
        p, _ = model.probabilities([texts[i] for i in theirs])
        well = np.bincount(labels[own], minlength=len(LANGUAGES)) >= 20
        wrong = (p.argmax(axis=1) != labels[theirs]) & (p.max(axis=1) >= 0.7) & well[labels[theirs]]
        keep[theirs[wrong]] = False
    return np.flatnonzero(keep)


def _train(texts: list[str], labels: np.ndarray, epochs: int, rate: float, seed: int, least_steps: int = LEAST_STEPS) -> tuple[Model, float]:
    """Fits embeddings and softmax by SGD on seven eighths of the sentences and the temperature on the rest.

    Labels may be wrong here and there: after half the epochs sentences that the
    model firmly gives another language are set aside.
    """
    rng = np.random.default_rng(seed)
    k = len(LANGUAGES)
    grams, bounds = features(texts)
    counts = np.diff(np.append(bounds, len(grams)))
    held = rng.random(len(texts)) < 1 / 8
    fit = np.flatnonzero(~held & (counts > 0))
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    weight = np.ones(len(texts), np.float32)
    share = np.maximum(np.bincount(labels[fit], minlength=k), 1)
    balance = (len(fit) / (k * share)).clip(0.2, 5).astype(np.float32)
    size = 64
    epochs = max(epochs, -(-least_steps * size // max(1, len(fit))))

    small = grams.astype(np.uint16)  # BUCKETS fit, and small numbers sort fast

    for epoch in range(epochs):
        rng.shuffle(fit)
        step = rate * (1 - epoch / epochs)
        # The epoch's features in the order of its sentences, and where each sentence's begin.
        length = counts[fit]
        begin = np.concatenate(([0], np.cumsum(length)))
        every = small[np.arange(begin[-1]) - np.repeat(begin[:-1] - bounds[fit], length)]
        for i in range(0, len(fit), size):
            rows = fit[i:i + size]
            n, cut = length[i:i + size], begin[i:i + len(rows)] - begin[i]
            flat = every[begin[i]:begin[i] + n.sum()]
            h = np.add.reduceat(np.take(e, flat, axis=0), cut, axis=0) / n[:, None]
            z = h @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            y = labels[rows]
            if epoch * 2 >= epochs:  # a wrong label: the model is sure of another language
                weight[rows] = np.where(p[np.arange(len(rows)), y] < 0.1, 0, 1)
            p[np.arange(len(rows)), y] -= 1
            g = p * (weight[rows] * balance[y])[:, None] / len(rows)
            back = (g @ w.T) / n[:, None]
            w -= step * h.T @ g
            b -= step * g.sum(axis=0) * 0.1
            order = np.argsort(flat, kind="stable")  # a bucket met several times moves by the sum
            once = flat[order]
            first = np.flatnonzero(np.concatenate(([True], once[1:] != once[:-1])))
            moved = np.add.reduceat(np.take(back, np.repeat(np.arange(len(rows)), n)[order], axis=0), first, axis=0)
            e[once[first]] -= (step * len(rows) / 4) * moved
    table = (e @ w).astype(np.float32)
    seen = np.zeros(BUCKETS, bool)
    seen[grams[np.isin(np.repeat(np.arange(len(texts)), counts), fit)]] = True
    model = Model(np.nan_to_num(table), b, 1.0, seen)
    right = 1.0
    rest = np.flatnonzero(held & (counts > 0))
    if len(rest):
        p, _ = model.probabilities([texts[i] for i in rest])
        right = float((p.argmax(axis=1) == labels[rest]).mean())
        logits = np.log(p.clip(1e-12))
        keep = p[np.arange(len(rest)), labels[rest]] > 0.02
        best, model.temperature = np.inf, 1.0
        for t in np.geomspace(0.3, 8, 40):
            z = logits / t
            z -= z.max(axis=1, keepdims=True)
            nll = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(rest)), labels[rest]])[keep].mean() if keep.any() else 0
            if nll < best:
                best, model.temperature = nll, float(t)
    return model, right


# Spark.

_PIECE = 300_000  # characters whose features are in memory at once
LONGEST_TRAINING_TEXT = 20_000


def _pieces(segs: list[list[Segment]]) -> Iterator[list[tuple[int, Segment]]]:
    """Segments of consecutive documents, cut into bounded loads; one that is longer than a load stands alone."""
    load, size = [], 0
    for i, doc in enumerate(segs):
        for s in doc:
            load.append((i, s))
            size += len(s.text)
            if size > _PIECE:
                yield load
                load, size = [], 0
    if load:
        yield load


def classified(model: Model, texts: list[str | None]) -> Iterator[tuple[int, Segment, str | None, float]]:
    """Every segment of every text with its language, None if rejected, and the confidence."""
    for load in _pieces([segments(t) for t in texts]):
        p, known = model.probabilities([s.text for _, s in load])
        best = p.argmax(axis=1)
        for (i, s), b, conf, k in zip(load, best, p[np.arange(len(load)), best], known):
            sure = conf >= LEAST_CONFIDENCE and k >= 0.5
            yield i, s, LANGUAGES[b] if sure else None, float(conf)


def fitted(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Model | None:
    """Trains on about ``sample`` documents of each labelled language, chosen by a hash of their id.

    Only that sample comes to the driver: ``sample`` documents of at most
    ``LONGEST_TRAINING_TEXT`` characters for each of the languages, whatever the
    size of the corpus. Without any labelled sentence there is no model.
    """
    labelled = documents.select("doc_id", "text", normal_label(F.col("lang")).alias("label"))
    labelled = labelled.filter(F.col("label").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LONGEST_TRAINING_TEXT))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])[F.col("label")]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < share * 1_000_000
    rows = sorted(((r["doc_id"], r["label"], r["text"]) for r in labelled.filter(drawn).collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    texts, labels = [], []
    for _, label, text in rows:
        for s in segments(text):
            if s.whole:
                texts.append(s.text)
                labels.append(LANGUAGES.index(label))
    return train(texts, np.asarray(labels)) if texts else None


_LANG_SCHEMA = "row_id bigint, doc_id bigint, label string, at_offset int, lang string, confidence double, whole boolean, n_chars int"


def language_segments(documents: DataFrame, model: Model | None) -> DataFrame:
    """The language of every segment: ``doc_id``, ``label``, ``at_offset``, ``lang``, ``confidence``, ``whole``, ``n_chars``.

    ``label`` is the language that the stored label means, or null. ``lang`` is
    null for a rejected segment. Null, empty and blank texts, and texts of code,
    numbers or logs alone, have no segments. ``at_offset`` is where the
    segment's line begins, in code points.
    """
    schema = _LANG_SCHEMA.removeprefix("row_id bigint, ")
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: BUCKETS times the number of languages

    def examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch.text]
            ids, labels = batch.doc_id.tolist(), batch.label.tolist()
            out = [(ids[i], labels[i], s.begin, lang, conf, s.whole, len(s.text)) for i, s, lang, conf in classified(shared.value, texts)]
            frame = pd.DataFrame(out, columns=["doc_id", "label", "at_offset", "lang", "confidence", "whole", "n_chars"])
            yield frame.astype({"at_offset": "int32", "n_chars": "int32"})

    return spread(documents.select("doc_id", "text", normal_label(F.col("lang")).alias("label")), "doc_id").mapInPandas(examine, schema)


def document_languages(found: DataFrame) -> DataFrame:
    """For each document with a whole sentence: ``label``, its ``main`` language, ``confidence``, ``share`` and all ``langs``.

    The main language has the most characters in whole sentences; ties go to
    the first by name. ``confidence`` is the mean of its segments' confidences.
    """
    whole = found.filter("whole and lang is not null")
    each = whole.groupBy("doc_id", "label", "lang").agg(F.sum("n_chars").alias("n"), F.avg("confidence").alias("c"))
    best = F.max_by(F.struct("lang", "c", "n"), F.struct(F.col("n"), -F.ascii("lang"), -F.ascii(F.substring("lang", 2, 1))))
    docs = each.groupBy("doc_id", "label").agg(best.alias("b"), F.sum("n").alias("total"), F.array_sort(F.collect_set("lang")).alias("langs"))
    return docs.select("doc_id", "label", F.col("b.lang").alias("main"), F.round("b.c", 6).alias("confidence"), F.round(F.col("b.n") / F.col("total"), 6).alias("share"), "langs")


def mislabelled(docs: DataFrame) -> DataFrame:
    """One row for each language of a document whose label is missing, wrong or hides a mixture: ``doc_id``, ``lang``."""
    right = (F.size("langs") == 1) & F.coalesce(F.col("label") == F.col("langs")[0], F.lit(False))
    return docs.filter(~right).select("doc_id", F.explode("langs").alias("lang"))
