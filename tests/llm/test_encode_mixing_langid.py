import base64
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import langid
from codeloom.llm.encode import PATTERN, VOCABULARY, Encoder, token_counts, token_ids
from codeloom.llm.langid import LANGUAGES, document_languages, fitted, language_segments, mislabelled, normal_label, segments, train
from codeloom.llm.mixing import mixture, rake, reached_shares

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")

# Encoding


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "\n\n\t x  ", "<|endoftext|> plain", "aaaaaaaaaaaaaaaa" * 50, "日本語 テスト🙂🙂", "don't I'LL we'Ve", "x" * 5000 + "\u0000\u200b", "éé  \u2028   …", "1234567890 " * 300]


@needs_vocabulary
def test_ids_equal_the_public_encoder(reference):
    enc = Encoder(VOCABULARY)
    for _ in range(2):  # the second time from memory
        ids, counts = enc.encode(TEXTS)
        at = 0
        for t, n in zip(TEXTS, counts):
            assert ids[at:at + n].tolist() == reference.encode_ordinary(t or "")
            at += n


@needs_vocabulary
@given(st.lists(st.text(max_size=80), max_size=8))
@settings(max_examples=60, deadline=None)
def test_random_texts(reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = Encoder.encode(_shared(), texts)
    assert ids.tolist() == [i for t in texts for i in reference.encode_ordinary(t)]


_memo = {}


def _shared():
    return _memo.setdefault("e", Encoder(VOCABULARY))


@needs_vocabulary
def test_forgets_when_full(monkeypatch, reference):
    monkeypatch.setattr("codeloom.llm.encode.MOST_WORDS", 3)
    enc = Encoder(VOCABULARY)
    for t in ("one two three four five", "six seven one", "one two"):
        assert enc.encode([t])[0].tolist() == reference.encode_ordinary(t)


@needs_vocabulary
def test_token_ids(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, "twice", "c"), (None, "no key", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = sorted((str(r["doc_id"]), r["ids"]) for r in token_ids(df).collect())
    assert got == sorted((str(i), reference.encode_ordinary(t or "")) for i, t, _ in rows)
    counts = sorted((str(r["doc_id"]), r["ids"], r["n_tokens"]) for r in token_counts(df, ["doc_id", "ids"]).collect())
    assert counts == sorted((str(i), c, len(reference.encode_ordinary(t or ""))) for i, t, c in rows)
    assert token_ids(df.limit(0)).count() == 0 and token_counts(df.limit(0)).count() == 0


# Mixing


def test_rake_meets_marginals():
    cells = np.array([[a, b, c] for a in range(3) for b in range(2) for c in range(2)])
    tokens = np.arange(1, 13, dtype=float)
    targets = [np.array([10.0, 20, 30]), np.array([25.0, 35]), np.array([40.0, 20])]
    w = rake(cells, tokens, np.full(12, 1e9), targets)
    for d, t in enumerate(targets):
        assert np.bincount(cells[:, d], w, len(t)) == pytest.approx(t, rel=1e-6)
    caps = np.full(12, 6.0)
    w = rake(cells, tokens, caps, [np.array([10.0, 20, 22]), *targets[1:]])
    assert (w <= caps + 1e-9).all() and np.bincount(cells[:, 0], w, 3) == pytest.approx([10, 20, 22], rel=1e-6)


WEIGHTS = "source string, target_share double, max_repeats int"
COUNTED = "doc_id bigint, source string, language string, topic string, n_tokens bigint, target_share string, xi int"


def counted(spark, n=1500, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["big", "small", "tiny", "unlisted", None], [60, 25, 8, 6, 1])[0]
        rows.append((i, source, rng.choice(["en", "de", None]), rng.choice(["a", "b"]), rng.choice([0, 5, 50, 100, 400]), "clash", 1))
    return rows, spark.createDataFrame(rows, COUNTED)


def test_shares_and_caps(spark):
    rows, df = counted(spark)
    weights = spark.createDataFrame([("big", 0.3, 1), ("small", 0.3, 2), ("tiny", 0.3, 3), ("absent", 0.1, 5), ("zero", 0.0, 5), (None, 0.1, 1)], WEIGHTS)
    mixed = mixture(df, weights)
    got = mixed.collect()
    caps, tokens = {"big": 1, "small": 2, "tiny": 3}, defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows if r[1] in caps and r[4] > 0)
    for r in got:
        assert 0 <= r["copies"] <= caps[r["source"]]
        tokens[r["source"]] += r["copies"] * r["n_tokens"]
    # The total is what the scarcest source can feed; every source ends within one document of its share.
    pool = {s: sum(r[4] for r in rows if r[1] == s) for s in caps}
    total = min(pool[s] * caps[s] / 0.3 for s in caps)
    for s in caps:
        assert abs(tokens[s] - 0.3 * total) <= 400, (s, tokens[s], 0.3 * total)
    shares = {r["source"]: r["reached_share"] for r in reached_shares(mixed, weights).collect()}
    assert shares["absent"] == 0 and shares["big"] == pytest.approx(1 / 3, abs=0.02)
    assert sorted(map(tuple, mixture(df.repartition(7), weights).collect())) == sorted(map(tuple, got))


def test_mixing_nothing(spark):
    _, df = counted(spark, 40)
    weights = spark.createDataFrame([("nowhere", 1.0, 1)], WEIGHTS)
    assert mixture(df, weights).count() == 0 and mixture(df.limit(0), weights).count() == 0 and mixture(df, weights.limit(0)).count() == 0
    assert [r["reached_share"] for r in reached_shares(mixture(df, weights), weights).collect()] == [0.0]
    one = spark.createDataFrame([(1, "s", None, None, 7, "", 0)], COUNTED)
    assert [tuple(r) for r in mixture(one, spark.createDataFrame([("s", 1.0, 3)], WEIGHTS)).collect()] == [(1, "s", 7, 3)]


# Languages

WORDS = {
    "en": "the parser reads every file once and then passes result to index which must be rebuilt before anyone can trust it",
    "de": "der leser liest jede datei genau einmal und danach folgt das verzeichnis welches neu gebaut werden muss bevor man ihm traut",
    "fr": "le lecteur lit chaque fichier une seule fois puis vient la liste qui doit être reconstruite avant que l'on puisse lui faire confiance",
    "es": "el lector lee cada archivo una sola vez y después sigue la lista que debe ser reconstruida antes de que sea fiable para todos",
    "pt": "o leitor lê cada ficheiro uma única vez e depois segue a lista que deve ser reconstruída antes que seja de confiança para todos",
    "it": "il lettore legge ogni documento una sola volta e poi segue la lista che deve essere ricostruita prima che sia affidabile per tutti",
    "ru": "читатель читает каждый файл один раз и затем следует список который нужно построить заново прежде чем ему можно верить",
    "ja": "夜間 実行 は 各 ファイル を 一度 だけ 読み その 後 で 索引 に 渡します 結果 信頼 する 前 に 作り直す 必要 が あります",
}


def sentence(lang, rng):
    words = WORDS[lang].split()
    picked = [rng.choice(words) for _ in range(rng.randrange(6, 14))]
    return "".join(picked) + "。" if lang == "ja" else " ".join(picked).capitalize() + "."


def corpus(n, seed, wrong=0.05):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = LANGUAGES[i % 8]
        text = " ".join(sentence(lang, rng) for _ in range(rng.randrange(2, 5)))
        rows.append((i, text, rng.choice(LANGUAGES) if rng.random() < wrong else lang, lang))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(400, 1)
    pairs = [(s.text, LANGUAGES.index(label)) for _, text, label, _ in rows for s in segments(text)]
    return train([t for t, _ in pairs], np.array([y for _, y in pairs]))


def test_held_out_accuracy_and_calibration(model):
    rows = corpus(240, 99)
    p, known = model.probabilities([text for _, text, _, _ in rows])
    right = p.argmax(axis=1) == [LANGUAGES.index(lang) for *_, lang in rows]
    assert right.mean() >= 0.98 and (known > 0.7).all() and np.allclose(p.sum(axis=1), 1)
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.15


def test_unknown_script_is_not_known(model):
    _, known = model.probabilities(["ქართული ენა არის ლამაზი", ""])
    assert known[0] < 0.5


def test_training_is_deterministic(model):
    pairs = [(s.text, LANGUAGES.index(label)) for _, text, label, _ in corpus(40, 1) for s in segments(text)]
    a, b = (train([t for t, _ in pairs], np.array([y for _, y in pairs])) for _ in range(2))
    assert np.array_equal(a.table, b.table) and a.temperature == b.temperature


@pytest.mark.parametrize(
    "text,whole",
    [
        ("One whole sentence here. Another one follows!", 2), ("# A heading of words\n\nplain words without an end", 0), ("```py\nThis is inside of code.\n```\nThis one is outside of it.", 1), ("```\nNever closed. Still code here.", 0),
        ("[12:00:01] 0xff something was logged here.\n2024-01-01 more of the same here.", 0), ("| a | b |\n| this is | a table. |", 0), ("- A listed sentence with words.\n    - A nested one with words too.\n", 2), ("    indented code stays out of it.", 0),
        ("See `foo.bar()` or https://x.y/z.html for the details.", 1), ("x = 1; y = 2;", 0), ("名前が変わるたびに655行を確認してください。これは短い。", 1), ("Version 1.2.3 of the file core/a.ts is the newest one.", 1), ("«Quoted words are here.» And then the rest follows.", 2), ("", 0), (None, 0), ("\u200b  ", 0), ("42", 0),
    ],
)
def test_segments(text, whole):
    assert sum(s.whole for s in segments(text)) == whole


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["EN", "en_GB", " Deutsch ", "por", "pt-BR", "日本語", "xx", "und", "", None, "??", "zh", "Spanish (ES)"]], "lang string")
    assert [r[0] for r in df.select(normal_label(F.col("lang"))).collect()] == ["en", "en", "de", "pt", "pt", "ja", None, None, None, None, None, None, "es"]


def test_found(spark):
    rng = random.Random(7)
    rows = [(i, t, label, "clash") for i, t, label, _ in corpus(320, 5, wrong=0)]
    odd = [
        (1000, sentence("de", rng) * 1, None, {"de"}), (1001, sentence("fr", rng), "en", {"fr"}), (1002, sentence("en", rng), "English", set()), (1003, sentence("en", rng) + " " + sentence("ja", rng), "en", {"en", "ja"}),
        (1004, None, "en", set()), (1005, "", None, set()), (1006, "```\ncode(1);\n```", "de", set()), (1007, sentence("ru", rng) + "\n\n" + "x" * 30_000 + " 7", "ru", set()), (1008, " ".join(sentence("it", rng) for _ in range(900)), "", {"it"}),
    ]
    df = spark.createDataFrame(rows + [(i, t, label, "clash") for i, t, label, _ in odd], "doc_id bigint, text string, lang string, whole string").repartition(4)
    model = fitted(df)
    found = language_segments(df, model)
    got = defaultdict(set)
    for r in mislabelled(document_languages(found)).collect():
        got[r["doc_id"]].add(r["lang"])
    assert {i: want for i, _, _, want in odd if want} == {i: v for i, v in got.items() if i >= 1000}
    assert sum(i < 1000 for i in got) <= 6
    docs = {r["doc_id"]: r for r in document_languages(found).collect()}
    assert docs[1001]["main"] == "fr" and 0 < docs[1001]["confidence"] <= 1 and docs[1003]["langs"] == ["en", "ja"] and 1004 not in docs
    none = df.limit(0)
    assert fitted(none) is None and language_segments(none, fitted(none)).count() == 0 and language_segments(df, None).count() == 0


def test_long_text_is_cut_into_loads(model, monkeypatch):
    monkeypatch.setattr(langid, "_PIECE", 200)
    text = " ".join(sentence("es", random.Random(2)) for _ in range(60))
    assert {lang for _, s, lang, _ in langid.classified(model, [text, None, text])} == {"es"}
