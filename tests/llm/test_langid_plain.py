"""The language model and its predictions against plain dictionaries."""

import math
import unicodedata
import zlib
from collections import Counter

import pytest

from stockloom.llm import langid


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)
        if kind[0] == "L" or kind[0] == "M" and word:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_model(rows):
    """Counts of words (length 0) and n-grams by language, of those found twice in some language, and totals of all."""
    counts = {}
    for doc_id, text, lang in {r[:3] for r in rows}:
        if lang is None or text is None or doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2:
            continue
        for w in plain_words(text):
            for n in range(6):
                pieces = [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n else [w]
                counts.setdefault((lang, n), Counter()).update(pieces)
    totals = {k: sum(c.values()) for k, c in counts.items()}
    unknown = 1 + math.log10(max(totals.values()))
    known = {n: {e for (_, m), c in counts.items() if m == n for e, k in c.items() if k > 1} for n in range(6)}
    return sorted({lang for lang, _ in counts}), counts, totals, known, unknown


def plain_predict(model, text):
    languages, counts, totals, known, unknown = model

    def penalty(lang, n, entry):
        c = counts[lang, n][entry]
        return -math.log10(c / totals[lang, n]) if c else unknown

    words = plain_words(text)
    if not words:
        return "und", 0.0
    sums = dict.fromkeys(languages, 0.0)
    for w in words:
        for lang in languages:
            if w in known[0]:
                sums[lang] += penalty(lang, 0, w)
                continue
            for n in range(5, 0, -1):
                pieces = [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
                if any(p in known[n] for p in pieces):
                    sums[lang] += sum(penalty(lang, n, p) if p in known[n] else unknown for p in pieces) / len(pieces)
                    break
            else:
                sums[lang] += unknown
    means = {lang: s / len(words) for lang, s in sums.items()}
    best = min(languages, key=lambda x: (means[x], x))
    return best, 1 / sum(10 ** (-(m - means[best]) * math.sqrt(len(words))) for m in means.values())


def test_predictions_equal_plain_dictionaries(docs, rows):
    model = plain_model([r[:3] for r in rows])
    got = sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in langid.predict_documents(docs).collect()), key=repr)
    want = []
    for r in rows:
        lang, score = plain_predict(model, r[1])
        want.append((r[0], lang, score))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=lambda w: repr((w[0], w[1], round(w[2], 3))))]
    assert sorted(g[2] for g in got) == pytest.approx(sorted(w[2] for w in want), abs=2e-3)


def test_only_letters_make_words():
    assert langid.words_of("½ ² Ⅷ ③ 12 _ . 🙂") == []
    assert langid.words_of("हिन्दी में") == ["हिन्दी", "में"]
    assert langid.words_of("x²y a1b é́") == ["x", "y", "a", "b", "é́"]


def test_one_id_with_very_many_rows(spark):
    rows = [(8, "the same text of one id", "en")] * 500 + [(8, f"other text number {chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_language=100)
    assert 0 < model.words.penalties.size < 100 and "same" not in set(model.words)
